import math

import pytest
from pyspark.sql import functions as F

from passagework.operators import evaluation as ev


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def test_recall_and_precision(spark):
    got, rel = arr("a", "b", "c"), arr("b", "z")
    assert value(spark, ev.recall_at(got, rel, 1)) == 0 and value(spark, ev.recall_at(got, rel, 3)) == 0.5
    assert value(spark, ev.precision_at(got, rel, 3)) == pytest.approx(1 / 3) and value(spark, ev.precision_at(got, rel, 0)) == 0
    assert value(spark, ev.recall_at(got, arr(), 3)) == 0


def test_reciprocal_rank(spark):
    assert value(spark, ev.reciprocal_rank(arr("a", "b"), arr("b"))) == 0.5
    assert value(spark, ev.reciprocal_rank(arr("a"), arr("b"))) == 0


def test_ndcg(spark):
    dcg, ideal = 1 / math.log2(3), 1 + 1 / math.log2(3)
    assert value(spark, ev.ndcg_at(arr("a", "b"), arr("b", "c"), 3)) == pytest.approx(dcg / ideal)
    assert value(spark, ev.ndcg_at(arr("b"), arr("b"), 5)) == pytest.approx(1)
    assert value(spark, ev.ndcg_at(arr("b"), arr(), 5)) == 0


def test_fact_coverage(spark):
    assert value(spark, ev.fact_coverage(F.lit("Kept  for 28 Weeks"), arr("28 weeks|four weeks", "12 days"))) == 0.5
    assert value(spark, ev.fact_coverage(F.lit(""), arr())) == 1


def test_citation_precision(spark):
    assert value(spark, ev.citation_precision(arr("a", "a", "b"), arr("a"))) == 0.5
    assert value(spark, ev.citation_precision(arr(), arr("a"))) == 0


@pytest.mark.parametrize("p, want", [(0.5, 2), (0.95, 4), (0.25, 1)])
def test_nearest_rank(spark, p, want):
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x int")
    assert df.agg(ev.nearest_rank("x", p).alias("v")).first().v == want


def test_document_ranking_keeps_first_places(spark):
    hits = spark.createDataFrame([("q", 1, "b"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, "c")], "request_id string, position int, source_uri string")
    assert [r.source_uri for r in ev.document_ranking(hits, 2).orderBy("rank").collect()] == ["b", "a"]


def test_compare_runs(spark):
    s = "request_id string, rr double, ranking string"
    a = spark.createDataFrame([("1", 0.5, "x"), ("2", 1.0, "y"), ("3", 0.2, "z")], s)
    b = spark.createDataFrame([("1", 1.0, "w"), ("2", 0.5, "y"), ("4", 1.0, "z")], s)
    assert tuple(ev.compare_runs(a, b).first()) == (2, 1, 1, 1)


def test_report():
    assert "recall" in ev.report_text([{"k": 1, "recall": 0.5}]) and ev.report_text([]) == "no cases\n"

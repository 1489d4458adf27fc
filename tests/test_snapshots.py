import datetime as dt

from pyspark.sql import functions as F

from passagework.operators.snapshots import Listing, canonical_revision, canonical_uri, by_snapshot, snapshot_changes, with_values
from passagework.plans.snapshot_queries import p3_changed_statuses

SCHEMA = "n int, source string, uri string, revision string, at timestamp, snapshot_no string, value string"
T = lambda h: dt.datetime(2025, 1, 1, h)


def listing(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return Listing(df, "n", "source", "at", canonical_uri(F.col("uri")), canonical_revision(F.col("revision")))


def changes(spark, rows):
    return {(r.source, r.record_key, r.snapshot_no, r.change_kind) for r in snapshot_changes(listing(spark, rows), "test").collect()}


def test_added_removed_changed(spark):
    rows = [(1, "s", "a", "1", T(1)), (1, "s", "b", "1", T(1)), (2, "s", "a", "2", T(1)), (2, "s", "c", "1", T(1))]
    assert changes(spark, rows) == {("s", "a", 2, "changed"), ("s", "b", 2, "removed"), ("s", "c", 2, "added")}


def test_spellings_are_one_record(spark):
    rows = [(1, "s", "A//b%2Dc.md/", 'W/"AB"', T(1)), (2, "s", "  ./a/b-c.md", " ab ", T(1))]
    assert changes(spark, rows) == set()


def test_the_last_delivery_counts_and_ties_are_settled(spark):
    rows = [(1, "s", "a", "1", T(1)), (2, "s", "a", "2", T(3)), (2, "s", "a", "1", T(2)), (2, "s", "a", "2", T(3))]
    assert changes(spark, rows) == {("s", "a", 2, "changed")}
    tie = [(1, "s", "a", "2", T(1)), (2, "s", "a", "1", T(2)), (2, "s", "a", "2", T(2))]
    assert changes(spark, tie) == set()


def test_a_source_without_a_delivery_is_compared_with_its_last(spark):
    rows = [(1, "s", "a", "1", T(1)), (1, "t", "a", "1", T(1)), (2, "t", "a", "1", T(1)), (3, "s", "b", "1", T(1)), (3, "t", "a", "1", T(1))]
    assert changes(spark, rows) == {("s", "a", 3, "removed"), ("s", "b", 3, "added")}


def test_the_first_delivery_of_a_late_source_changes_nothing(spark):
    assert changes(spark, [(1, "s", "a", "1", T(1)), (2, "s", "a", "1", T(1)), (2, "t", "a", "1", T(1))]) == set()


def test_a_record_may_come_back(spark):
    rows = [(1, "s", "a", "1", T(1)), (1, "s", "b", "1", T(1)), (2, "s", "b", "1", T(1)), (3, "s", "a", "1", T(1)), (3, "s", "b", "1", T(1))]
    assert changes(spark, rows) == {("s", "a", 2, "removed"), ("s", "a", 3, "added")}


def test_nulls(spark):
    rows = [(1, None, "a", None, T(1)), (1, "s", None, "1", None), (2, None, "a", None, T(1)), (2, "s", None, None, T(1)), (None, "s", "z", "1", T(1))]
    assert changes(spark, rows) == {("s", None, 2, "changed")}


def test_empty(spark):
    assert changes(spark, []) == set()


def test_old_values_are_fetched_for_changes(spark):
    rows = [(1, "s", "a", "1", T(1)), (1, "s", "b", "1", T(1)), (2, "s", "a", "2", T(1)), (2, "s", "b", "1", T(1)), (3, "s", "b", None, T(1))]
    li = listing(spark, rows)
    got = {(r.record_key, r.snapshot_no, r.change_kind, r.old_value, r.new_value) for r in with_values(by_snapshot(li, "test"), snapshot_changes(li, "test")).collect()}
    assert got == {("a", 2, "changed", "1", "2"), ("a", 3, "removed", "2", None), ("b", 3, "changed", "1", None)}


def test_bad_escapes_stay(spark):
    df = spark.createDataFrame([("50%+off%zz.md",), (None,), ("%E4%BD%A0/",)], "u string").select(canonical_uri(F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == ["50%+off%zz.md", None, "你"]


def test_changed_statuses_have_their_values(spark, tmp_path):
    rows = [(1, "s", "a", " Ingested"), (1, "s", "b", "ingested"), (2, "s", "A/", "unchanged"), (2, "s", "b", "INGESTED")]
    spark.createDataFrame(rows, "sync_no int, source string, source_uri string, status string").selectExpr("*", "timestamp'2025-01-01' AS finished_at").write.parquet(f"{tmp_path}/sync_outcomes.parquet")
    assert [tuple(r) for r in p3_changed_statuses(spark, str(tmp_path)).select("source_uri", "change_kind", "old_value", "new_value").collect()] == [("a", "changed", "ingested", "unchanged")]

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import access as ac
from passagework.functions.stem import stem
from passagework.operators import retrieval as rt
from passagework.plans.access_queries import leaks

CH = "chunk_id long, doc_id long, access_group_ids array<int>, section_path string, content string, embedding array<float>, department string, doc_type string, classification string, source_updated_at timestamp"


@pytest.fixture(scope="module")
def chunks(spark):
    d = dt.datetime(2025, 1, 1)
    rows = [
        (1, 1, [1], "Leave", "parental leave policy", [1.0, 0.0], "hr", "policy", "internal", d),
        (2, 1, [2], "Leave", "secret leave numbers", [1.0, 0.0], "hr", "policy", "restricted", d),
        (3, 2, [1, 2], "Pay", "salary bands and leave", [0.0, 1.0], None, "guide", "internal", None),
        (4, 2, None, "Pay", "leave leave leave", [0.6, 0.8], "hr", "guide", "internal", d),
        (5, 3, [1], None, None, None, "hr", "guide", "internal", d),
        (6, 3, [1], "Pay", "leave policy", [0.0, 0.0], "hr", "guide", "internal", d),
    ]
    return spark.createDataFrame(rows, CH)


def ids(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_groups_have_no_default_and_must_be_a_tuple():
    with pytest.raises(TypeError):
        ac.Request("x")
    with pytest.raises(TypeError):
        ac.Request("x", [1])
    with pytest.raises(ValueError):
        ac.Request("x", (1,), 0)


def test_no_groups_sees_nothing(chunks):
    assert ac.scoped(chunks, ac.Request("leave", ())).count() == 0
    assert rt.search_keyword(chunks, ac.Request("leave", ())).count() == 0
    assert rt.search_vector(chunks, ac.Request("leave", ()), [1.0, 0.0]).count() == 0


def test_keyword_search_obeys_groups(chunks):
    assert set(ids(rt.search_keyword(chunks, ac.Request("leave", (1,))))) == {1, 3, 6}
    assert set(ids(rt.search_keyword(chunks, ac.Request("leave", (2,))))) == {2, 3}


def test_vector_search_breaks_ties_by_id(chunks):
    assert ids(rt.search_vector(chunks, ac.Request("x", (1, 2)), [1.0, 0.0])) == [1, 2, 3]


def test_filters_never_pass_nulls(chunks):
    f = ac.Filters(departments=("hr",), updated_before=dt.date(2025, 1, 1))
    assert {r.chunk_id for r in ac.scoped(chunks, ac.Request("x", (1, 2), filters=f)).collect()} == {1, 2, 5, 6}


def test_the_access_list_is_below_the_limit(chunks):
    plan = rt.search_keyword(chunks, ac.Request("leave", (1,)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Limit") < plan.index("arrays_overlap")


def test_a_table_of_requests_gives_what_single_requests_give(spark, chunks):
    asked = spark.createDataFrame([("a", "parental leave", [1], [1.0, 0.0]), ("b", "leave", [2], [0.0, 1.0]), ("c", "leave", None, [1.0, 0.0]), ("d", None, [1], None)], "request_id string, question string, group_ids array<int>, vector array<float>")
    kw = rt.keyword_topk(chunks, asked)
    for name, text, groups in (("a", "parental leave", (1,)), ("b", "leave", (2,))):
        assert ids(kw.where(F.col("request_id") == name)) == ids(rt.search_keyword(chunks, ac.Request(text, groups)))
    assert kw.where("request_id in ('c', 'd')").count() == 0
    v = rt.vector_topk(chunks, asked, dim=2)
    assert ids(v.where("request_id = 'a'")) == [1, 3]
    assert v.where("request_id = 'c'").count() == 0


def test_empty_tables(spark, chunks):
    asked = spark.createDataFrame([], "request_id string, question string, group_ids array<int>, vector array<float>")
    assert rt.keyword_topk(chunks, asked).count() == 0
    one = spark.createDataFrame([("a", "leave", [1], [1.0, 0.0])], asked.schema)
    assert rt.hybrid(chunks.limit(0), one).count() == 0


def test_parse_query():
    q = rt.parse_query('purchase order -"credit note" -invoice the')
    assert q.conjunctive and [(t.words, t.negated) for t in q.terms] == [(("purchase",), False), (("order",), False), (("credit", "note"), True), (("invoice",), True)]
    assert not rt.parse_query("well-known order").conjunctive
    assert rt.parse_query("the of -x").matches_nothing and rt.parse_query("").matches_nothing


def test_fusion(spark):
    s = "request_id string, chunk_id long, score double, rank int"
    k = spark.createDataFrame([("q", 1, 9.0, 1), ("q", 2, 8.0, 2)], s)
    v = spark.createDataFrame([("q", 2, 0.9, 1), ("q", 3, 0.8, 2)], s)
    got = rt.fuse(k, v).orderBy("position").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3]  # agreement beats a single first place
    assert got[0].rrf_score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and got[0].keyword_score == 8.0 and got[0].vector_rank == 1
    with pytest.raises(ValueError):
        rt.fuse(k, v, k=0)


def test_ties_of_the_batch_scorer_go_to_the_lesser_id():
    row, ids, scores = rt._top_of_batch(np.array([[1.0, 2.0, 2.0, 2.0, -np.inf]]), np.array([5, 9, 4, 7, 1]), 2)
    assert (row.tolist(), ids.tolist(), scores.tolist()) == ([0, 0], [4, 7], [2.0, 2.0])


def test_the_best_of_all_batches_of_a_task():
    r = np.random.default_rng(2)
    scores, ids, k = np.round(r.random((7, 90)), 1), r.permutation(90), 4
    scores[r.random(scores.shape) < 0.3] = -np.inf
    scores[3] = -np.inf  # nothing that this request may see
    kept = None
    for part in np.array_split(np.arange(90), 6):
        kept = rt._best_of(kept, rt._top_of_batch(scores[:, part].copy(), ids[part], k), k)
    got = {(int(q), int(i), float(s)) for q, i, s in zip(*kept)}
    want = {(q, i, s) for q in range(7) for s, i in sorted(((-float(s), int(i)) for s, i in zip(scores[q], ids) if np.isfinite(s)))[:k] for s in [-s]}
    assert got == want


def test_recheck_blocks_alone(chunks):
    kept, wrong = ac.recheck(chunks, (1,))
    assert {r.chunk_id for r in kept.collect()} == {1, 3, 5, 6} and wrong.count() == 2


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustment", "adjust"), ("rate", "rate"), ("controll", "control")])
def test_stems(word, want):
    assert stem(word) == want


def test_leaks_of_a_search_are_counted_at_every_position(spark):
    fused = spark.createDataFrame([("r", 1, 1), ("r", 2, 7), ("r", 3, 30), ("q", 1, 1)], "request_id string, chunk_id long, position int")
    asked = spark.createDataFrame([("r", [1]), ("q", None)], "request_id string, group_ids array<int>")
    acl = spark.createDataFrame([(1, [1]), (2, [2]), (3, [])], "chunk_id long, access_group_ids array<int>")
    assert leaks(fused, asked, acl).first().n_leaks == 3

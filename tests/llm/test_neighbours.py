import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import neighbours as nb

P = nb.Lists(dim=16, list_size=60, block=64)


def made(n=3000, dim=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(60, dim))[r.integers(0, 60, n)] + r.normal(size=(n, dim)) * 0.35
    return (x * r.uniform(0.5, 3, (n, 1))).astype(np.float32)


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], "k") for i, v in zip(ids, x)], "id long, embedding array<float>, key string")


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_recall(spark):
    x = made()
    want, s = exact(x, 10)
    got = nb.nearest(frame(spark, x), F.col("id") % 7 == 0, 10, P).toPandas()
    q = [i for i in range(len(x)) if i % 7 == 0]
    assert set(got.query_id) == set(q) and (got.groupby("query_id").size() == 10).all()
    by = got.groupby("query_id")["neighbour_id"].apply(set)
    assert np.mean([len(by[i] & set(want[i])) / 10 for i in q]) > 0.9
    r = got.iloc[0]
    assert r.similarity == pytest.approx(s[int(r.query_id), int(r.neighbour_id)], abs=1e-5)


def test_many_copies(spark):
    """A third of all rows are one vector: nothing is lost, and ties go to the lesser ids."""
    x = made(900)
    x[::3] = x[0]
    got = nb.nearest(frame(spark, x), F.col("id").isin(0, 300, 897), 10, P).toPandas()
    copies = list(range(0, 900, 3))
    for q in (0, 300, 897):
        assert got[got.query_id == q].sort_values("rank").neighbour_id.tolist() == [c for c in copies if c != q][:10]


def test_dirt(spark):
    x = [[1.0] + [0.0] * 15, [2.0] + [0.0] * 15, None, [0.0] * 16, [1.0], [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [1.0] + [0.0] * 15]
    got = nb.nearest(frame(spark, x, [1, 2, 3, 4, 5, 6, 7, 1]), F.lit(True), 10, P).collect()
    assert {(r.query_id, r.neighbour_id) for r in got} == {(1, 2), (2, 1)}


def test_empty(spark):
    assert nb.nearest(frame(spark, []), F.lit(True), 10, P).count() == 0


def test_the_graph_finds_the_nearest_centroids():
    c = nb._unit(np.random.default_rng(3).normal(size=(700, 24))).astype(np.float32)
    g = nb.CentroidGraph(c, 16)
    q = nb._unit(np.random.default_rng(4).normal(size=(200, 24))).astype(np.float32)
    ids, _ = g.search(q, 5)
    want = np.argsort(-(q @ c.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, want)]) > 0.85


def test_lists_are_balanced_and_boundaries_replicated():
    x = nb._unit(np.random.default_rng(8).normal(size=(4000, 16))).astype(np.float32)  # without clusters: all is boundary
    g = nb.CentroidGraph(nb.balanced_centroids(x, 90), 16)
    rows, lists = nb.home_lists(g, x, P)
    assert set(rows) == set(range(len(x))) and len(rows) > 1.02 * len(x)
    assert np.bincount(rows).max() <= P.replicas
    assert np.bincount(lists).max() < 400

"""The most similar vectors of every vector, by balanced posting lists.

Vectors are normalised and equal ones made one class, of which only the least k + 1 ids can ever be among k nearest.
On a bounded sample of the classes a balanced hierarchical clustering is fitted; its centroids and a neighbour graph
over them stay in memory on every executor. Each class is put into its nearest list and, near a boundary, into up to
`replicas` lists; a query searches the graph for lists and keeps those whose distance is within a ratio of the least.
Lists are stored in blocks, so that one that holds more than its share is searched by several tasks, and the queries of
such a list are split as well; every block is scanned with one matrix product, and the best of all blocks are merged.

Defined results: vectors that are null, of another length, all zero or with a null, NaN or infinite component take no
part; equal similarities are settled by the lesser id; a repeated id counts once; fewer than k others give fewer rows;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.workspace import materialise


@dataclass(frozen=True)
class Lists:
    dim: int = 64
    list_size: int = 400  # classes to a list, aimed at
    max_lists: int = 16_384  # bounds what is sent to executors: 16,384 x 64 floats and 16 neighbours each, 5 MB
    sample_per_list: int = 32  # classes the clustering is fitted on, at most 524,288
    replicas: int = 3
    closure: float = 1.15  # a further list takes a vector up to this multiple of its least distance
    probes: int = 16
    ratio: float = 1.6  # a further list is searched up to this multiple of the query's least distance
    block: int = 4096
    degree: int = 16


# --- the model ---------------------------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-9, _unit(total), c)
    return (x @ c.T).argmax(1)


def balanced_centroids(x: np.ndarray, target: int, fan_out: int = 16, seed: int = 7) -> np.ndarray:
    """Clusters are cut again until they hold at most `target` vectors."""
    rng, out, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= target:
            out.append(_unit(x[rows].mean(0)))
            continue
        k = min(fan_out, max(2, math.ceil(len(rows) / target)))
        near = _k_means(x[rows], k, rng)
        parts = [rows[near == j] for j in range(k) if (near == j).any()]
        if len(parts) == 1:  # cannot be told apart
            out.append(_unit(x[rows].mean(0)))
        else:
            todo += parts
    return np.array(out, np.float32)


class CentroidGraph:
    """Nearest-neighbour graph over the centroids with a best-first search for many queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int, seed: int = 11):
        self.c = centroids
        k = len(centroids)
        degree = min(degree, k)
        self.near = np.empty((k, degree), np.int32)
        for s in range(0, k, 2048):
            sim = centroids[s : s + 2048] @ centroids.T
            self.near[s : s + 2048] = np.argpartition(-sim, degree - 1, axis=1)[:, :degree]
        self.entries = np.random.default_rng(seed).choice(k, min(k, max(64, math.isqrt(k) * 5)), replace=False)

    def search(self, q: np.ndarray, width: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of about the `width` nearest centroids, nearest first."""
        parts = [self._search(q[s : s + batch], min(width, len(self.c))) for s in range(0, len(q), batch)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        b, beam = len(q), min(len(self.c), max(width, 32))
        rows = np.arange(b)[:, None]
        sim = q @ self.c[self.entries].T
        first = min(beam, len(self.entries))
        best = np.argpartition(-sim, first - 1, axis=1)[:, :first]
        ids, sims = self.entries[best], np.take_along_axis(sim, best, 1)
        seen = np.zeros((b, len(self.c)), bool)
        seen[:, self.entries] = True
        opened = np.zeros(ids.shape, bool)
        while True:
            rank = np.where(opened, -np.inf, sims)
            step = min(4, ids.shape[1])
            pick = np.argpartition(-rank, step - 1, axis=1)[:, :step]
            live = np.isfinite(np.take_along_axis(rank, pick, 1))
            if not live.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            new = self.near[np.take_along_axis(ids, pick, 1)].reshape(b, -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.near.shape[1], axis=1)
            seen[rows, new] |= fresh
            s = np.where(fresh, np.matmul(self.c[new], q[:, :, None])[:, :, 0], -np.inf)
            # a centroid reached twice in one step is kept once
            order = np.argsort(new, axis=1, kind="stable")
            sorted_new = np.take_along_axis(new, order, 1)
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], 1)
            s = np.where(again, -np.inf, s)
            ids, sims, opened = np.concatenate([ids, new], 1), np.concatenate([sims, s], 1), np.concatenate([opened, ~np.isfinite(s)], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, opened = (np.take_along_axis(v, keep, 1) for v in (ids, sims, opened))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sim, 1e-12))


def home_lists(graph: CentroidGraph, x: np.ndarray, p: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every placement. A list is skipped if a list chosen before is nearer to it than the vector is."""
    ids, sims = graph.search(x, 2 * p.replicas + 2)
    d = _distance(sims)
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    for j in range(1, ids.shape[1]):
        ok = (d[:, j] <= p.closure * d[:, 0]) & (chosen.sum(1) < p.replicas) & np.isfinite(sims[:, j])
        for i in range(j):
            between = _distance((graph.c[ids[:, i]] * graph.c[ids[:, j]]).sum(1))
            ok &= ~(chosen[:, i] & (between < d[:, j]))
        chosen[:, j] = ok
    rows, cols = np.nonzero(chosen)
    return rows, ids[rows, cols]


def probe_lists(graph: CentroidGraph, q: np.ndarray, p: Lists) -> tuple[np.ndarray, np.ndarray]:
    ids, sims = graph.search(q, p.probes)
    d = _distance(sims)
    rows, cols = np.nonzero((d <= p.ratio * d[:, :1]) & np.isfinite(sims))
    return rows, ids[rows, cols]


# --- Spark -------------------------------------------------------------------------------------------------------------


def _flat(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def keyed_vectors(vectors: DataFrame, p: Lists) -> DataFrame:
    """vectors: id, embedding. key, id, vec (unit float32 bytes) of those that take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            ok = np.isfinite(n) & (n > 0)
            raw = [v.tobytes() for v in (x[ok] / n[ok, None]).astype(np.float32)]
            yield pd.DataFrame({"key": [xxhash.xxh128_digest(v) for v in raw], "id": pdf["id"].to_numpy()[ok], "vec": raw})

    usable = vectors.where((F.size("embedding") == p.dim) & ~F.exists("embedding", lambda e: e.isNull()) & F.col("id").isNotNull())
    return usable.select("id", "embedding").mapInPandas(run, "key binary, id long, vec binary")


def vector_classes(vectors: DataFrame, k: int, p: Lists) -> DataFrame:
    """key, vec, ids: the least k + 1 ids of each class of equal vectors."""
    keyed = keyed_vectors(vectors, p)
    # dense_rank limits every class before the shuffle, however many copies it has
    ranked = keyed.withColumn("rank", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rank") <= k + 1)
    return ranked.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids"))


def fit(classes: DataFrame, p: Lists) -> tuple[CentroidGraph, np.ndarray]:
    """The graph, and the number of blocks of every list as the sample lets expect."""
    n = classes.count()
    lists = min(p.max_lists, max(1, round(n / p.list_size)))
    wanted = lists * p.sample_per_list
    share = min(1.0, wanted / max(n, 1))
    sample = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000))).select("vec").limit(wanted + wanted // 4).toArrow()
    x = np.frombuffer(b"".join(v.as_py() for v in sample["vec"]), np.float32).reshape(-1, p.dim)
    graph = CentroidGraph(balanced_centroids(x, max(1, round(len(x) / lists * 1.5))), p.degree)
    expected = np.bincount(home_lists(graph, x, p)[1], minlength=len(graph.c)) * (n / len(x))
    return graph, np.maximum(1, np.ceil(expected / p.block)).astype(np.int32)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, p: Lists = Lists()) -> DataFrame:
    """vectors: id, embedding; queries: which rows ask. query_id, neighbour_id, similarity, rank 1..k."""
    spark = vectors.sparkSession
    schema = "query_id long, neighbour_id long, similarity double, rank int"
    classes = materialise(vector_classes(vectors, k, p), "vector-classes")
    if classes.isEmpty():
        return spark.createDataFrame([], schema)
    graph, blocks = fit(classes, p)
    model = spark.sparkContext.broadcast((graph, blocks))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n_blocks = model.value
        for pdf in batches:
            if len(pdf):
                rows, lists = home_lists(g, _flat(pdf["vec"], p.dim), p)
                picked = pdf.iloc[rows]
                salt = np.array([int.from_bytes(v[:4], "big") for v in picked["key"]], np.int64)
                # a list of several blocks has as many parts of its queries, and every part meets every block
                times = n_blocks[lists]
                again = np.repeat(np.arange(len(rows)), times)
                part = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                picked, lists, salt = picked.iloc[again], lists[again], salt[again]
                yield pd.DataFrame({"list": lists.astype(np.int32), "block": (salt % n_blocks[lists]).astype(np.int32), "part": part.astype(np.int32), "key": picked["key"].to_numpy(), "vec": picked["vec"].to_numpy(), "least": np.array([v[0] for v in picked["ids"]], np.int64)})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n_blocks = model.value
        for pdf in batches:
            if len(pdf):
                rows, lists = probe_lists(g, _flat(pdf["vec"], p.dim), p)
                times = n_blocks[lists]
                again = np.repeat(np.arange(len(rows)), times)
                block = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                picked = pdf.iloc[rows[again]]
                salt = np.array([int.from_bytes(v[4:8], "big") for v in picked["key"]], np.int64)
                yield pd.DataFrame({"list": lists[again].astype(np.int32), "block": block.astype(np.int32), "part": (salt % n_blocks[lists[again]]).astype(np.int32), "query": picked["key"].to_numpy(), "vec": picked["vec"].to_numpy()})

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, keys, least = _flat(left["vec"], p.dim), left["key"].to_numpy(), left["least"].to_numpy()
            take = min(k + 1, len(x))
            for s in range(0, len(right), 1024):
                part = right.iloc[s : s + 1024]
                sim = _flat(part["vec"], p.dim) @ x.T
                top = np.argpartition(-sim, take - 1, axis=1)[:, :take]
                out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), take), "key": keys[top.ravel()], "least": least[top.ravel()], "similarity": np.take_along_axis(sim, top, 1).ravel().astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "least": np.empty(0, np.int64), "similarity": np.empty(0)})

    key_of = vectors.where(queries).select("id")
    asked = classes.select("key", "vec", F.explode("ids").alias("id")).join(key_of.distinct(), "id", "left_semi")
    # a query beyond the least ids of its class is found by its vector
    rest = key_of.distinct().join(asked.select("id"), "id", "left_anti")
    late = keyed_vectors(vectors.join(rest, "id", "left_semi"), p).select("key", "id")
    query_keys = materialise(asked.select("key", "id").unionByName(late).distinct(), "vector-queries")
    asking = classes.join(query_keys.select("key").distinct(), "key", "left_semi")
    postings = classes.mapInPandas(post, "list int, block int, part int, key binary, vec binary, least long").groupBy("list", "block", "part")
    hits = postings.cogroup(asking.mapInPandas(ask, "list int, block int, part int, query binary, vec binary").groupBy("list", "block", "part")).applyInPandas(scan, "query binary, key binary, least long, similarity double")
    merged = hits.groupBy("query", "key").agg(F.max("similarity").alias("similarity"), F.min("least").alias("least"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "least"))).where(F.col("r") <= k + 1)
    members = classes.select("key", F.explode("ids").alias("neighbour_id"))
    pool = best.join(members, "key").select("query", "neighbour_id", "similarity")
    # k + 1 ids are enough for every query of the class, itself left out
    pool = pool.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour_id"))).where(F.col("r") <= k + 1)
    each = query_keys.select(F.col("key").alias("query"), F.col("id").alias("query_id")).join(pool, "query").where("neighbour_id <> query_id")
    final = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))).where(F.col("rank") <= k)
    return final.select("query_id", "neighbour_id", "similarity", "rank")

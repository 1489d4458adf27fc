"""Connected components of a large graph, by alternating star contraction; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.workspace import materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges u > v. Large star: every larger neighbour is linked to the least of neighbours and self; small star: every
    smaller neighbour and self are. Minima are combined before the shuffle, and no neighbourhood is gathered."""
    if small:
        near = edges
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = near.join(least, "u").where("v > u").select(F.col("v").alias("x"), "m")
    return out.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """id, component: the least id reachable. Ids without a link are not listed."""
    edges = materialise(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star")
    before = None
    for _ in range(max_rounds):
        edges = materialise(_star(_star(edges, small=False), small=True), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

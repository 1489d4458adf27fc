"""Sliding-window rate limit over a log of requests. A refused request does not count, so every decision depends on the
decisions before it: a fold per key, not a window frame."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingWindow:
    """Seconds to wait, or None if the hit is allowed."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.hits = limit, seconds, deque()

    def hit(self, now: float) -> float | None:
        while self.hits and self.hits[0] <= now - self.seconds:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return self.hits[0] + self.seconds - now
        self.hits.append(now)
        return None


def limited(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """hits: key, hit_id, at (timestamp). hit_id, allowed, retry_after in seconds. Each key is read in order of time by one
    task, but as a stream: a key may have any number of hits, and of them at most `limit` are held."""
    order = hits.where("key is not null and at is not null").select("key", "hit_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, None
        for pdf in batches:
            wait = []
            for k, us in zip(pdf["key"].tolist(), pdf["us"].tolist()):
                if k != key or window is None:
                    key, window = k, SlidingWindow(limit, seconds * 1_000_000)
                wait.append(window.hit(us))
            yield pd.DataFrame({"hit_id": pdf["hit_id"], "allowed": [w is None for w in wait], "retry_after": [None if w is None else round(w / 1e6, 6) for w in wait]}).astype({"retry_after": "float64"})

    return order.repartition("key").sortWithinPartitions("key", "us", "hit_id").mapInPandas(run, "hit_id long, allowed boolean, retry_after double")

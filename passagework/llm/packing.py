"""Filling fixed-capacity sequences with whole documents, at a controlled mixture of sources.

Documents are measured with a public tokenizer; those over the capacity become pieces of it. Items are spread over
shards by hash, so that no source or copy makes a shard large. In a shard every source has a queue; deficit round-robin
fills one window of sequences after the other: each source may take its share of the window plus the deficit it
carries. What a window takes is placed best fit, longest first, into sequences that stay open across windows. The
deficit with which a shard begins is what all shards before it left, known from their totals alone; under a given target,
which the corpus need not have, shards begin even.

Defined results: null and empty texts are items of no token, placed like any other, so that every document is
assigned; a null source is a source and a null id an id; repeated rows are items of their own, told apart by `copy_no`; an empty table gives
no rows; a zero or missing target share is served when the other queues are empty; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.workspace import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer of byte_bpe_50k cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    window: int = 64  # sequences to a round of the queues
    shard_tokens: int = 4_000_000
    shares: dict[str, float] | None = field(default=None, hash=False)  # target shares of tokens; None: as in the corpus
    temper: float | None = None  # without `shares`: target shares in proportion to the corpus' raised to this power
    tokenizer: str = TOKENIZER


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ITEMS = "doc_id long, copy_no int, source string, piece_no int, token_start long, n_tokens int"


def measured_items(documents: DataFrame, p: Packing) -> DataFrame:
    """documents: doc_id, source, text. One row per document, or per piece of one over the capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load_tokenizer(p.tokenizer)
        for pdf in batches:
            n = np.fromiter((len(tok.encode_to_numpy(t)) if t else 0 for t in pdf["text"]), np.int64, len(pdf))
            pieces = np.maximum(1, -(-n // p.capacity))
            again = np.repeat(np.arange(len(pdf)), pieces)
            no = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[again], "source": pdf["source"].to_numpy()[again], "piece_no": no.astype(np.int32), "token_start": no * p.capacity, "n_tokens": np.minimum(p.capacity, n[again] - no * p.capacity).astype(np.int32)})

    made = documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, piece_no int, token_start long, n_tokens int")
    copy = F.row_number().over(Window.partitionBy("doc_id", "piece_no").orderBy("source", "n_tokens")) - 1
    return made.withColumn("copy_no", copy)


def target_shares(items: DataFrame, p: Packing) -> DataFrame:
    """source, share."""
    held = items.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if p.shares is None:
        if p.temper is not None:
            held = held.withColumn("tokens", F.pow(F.col("tokens").cast("double"), F.lit(p.temper)))
        total = F.sum("tokens").over(Window.partitionBy())  # one row per source
        return held.select("source", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"))
    spark = items.sparkSession
    given = spark.createDataFrame([(k, float(v)) for k, v in p.shares.items()], "source string, share double")
    return held.join(given, "source", "left").select("source", F.coalesce("share", F.lit(0.0)).alias("share"))


class OpenSequences:
    """Best fit over the sequences that still have room."""

    def __init__(self, capacity: int, keep: int = 512):
        self.capacity, self.keep = capacity, keep
        self.room: list[tuple[int, int]] = []  # (room, sequence), ascending
        self.made = 0

    def put(self, n: int) -> tuple[int, int]:
        """(sequence, position) of an item of n tokens."""
        i = bisect_left(self.room, (n, -1))
        if i < len(self.room):
            room, seq = self.room.pop(i)
        else:
            room, seq = self.capacity, self.made
            self.made += 1
        if room > n:
            insort(self.room, (room - n, seq))
            if len(self.room) > self.keep:
                self.room.pop(0)
        return seq, self.capacity - room


def round_robin(sizes: dict[str, deque], share: dict[str, float], deficit: dict[str, float], window_tokens: int) -> Iterator[list]:
    """Windows of items (n_tokens first) taken from the queues. `deficit` is carried from window to window."""
    waiting = [s for s in sizes if sizes[s]]
    while waiting:
        total = sum(share.get(s, 0) for s in waiting)
        taken = []
        for s in waiting:
            deficit[s] = deficit.get(s, 0.0) + window_tokens * (share.get(s, 0) / total if total > 0 else 1 / len(waiting))
            queue = sizes[s]
            while queue and queue[0][0] <= deficit[s]:
                item = queue.popleft()
                deficit[s] -= item[0]
                taken.append(item)
        waiting = [s for s in waiting if sizes[s]]
        if taken:
            yield taken


NULL_SOURCE = "\x00null"
OUT = "doc_id long, copy_no int, source string, piece_no int, token_start long, n_tokens int, shard int, sequence_no int, position int, window_no int"


def _pack(p: Packing):
    def run(key: tuple, items: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({c.split()[0]: [] for c in OUT.split(", ")})
        items = items.sort_values(["order", "doc_id", "piece_no", "copy_no"], kind="stable").reset_index(drop=True)
        names = [s if isinstance(s, str) else NULL_SOURCE for s in items["source"]]
        share = dict(zip(carried["source"], carried["share"]))
        deficit = dict(zip(share, carried["carry"]))
        queues: dict[str, deque] = {s: deque() for s in share}
        for i, (s, n) in enumerate(zip(names, items["n_tokens"].tolist())):
            queues.setdefault(s, deque()).append((n, i))
        bins = OpenSequences(p.capacity)
        seq, pos, win = (np.zeros(len(items), np.int32) for _ in range(3))
        for w, taken in enumerate(round_robin(queues, share, deficit, p.capacity * p.window)):
            for n, i in sorted(taken, reverse=True):
                seq[i], pos[i] = bins.put(n)
                win[i] = w
        out = items[["doc_id", "copy_no", "source", "piece_no", "token_start", "n_tokens"]].copy()
        out["shard"], out["sequence_no"], out["position"], out["window_no"] = np.int32(key[0]), seq, pos, win
        return out

    return run


def pack(documents: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Every document or piece with its sequence (shard, sequence_no) and its position there."""
    items = materialise(measured_items(documents, p), "pack-items")
    total = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, round(total / p.shard_tokens))
    placed = items.withColumn("order", F.xxhash64("doc_id", "piece_no", "copy_no")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    shares = target_shares(items, p)
    held = placed.groupBy("shard", "source").agg(F.sum("n_tokens").alias("tokens"))
    # what every source was owed by its part of the corpus and given by the shards before: one row per shard and source, no
    # item is read again; a target share that the corpus cannot fill is not carried from shard to shard for ever
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    all_before = held.groupBy("shard").agg(F.sum("tokens").alias("t")).select("shard", F.coalesce(F.sum("t").over(earlier()), F.lit(0)).alias("all_before"))
    given = held.withColumn("given", F.coalesce(F.sum("tokens").over(earlier("source")), F.lit(0)))
    key = F.coalesce("source", F.lit(NULL_SOURCE)).alias("key")
    natural = target_shares(items, replace(p, shares=None, temper=None)).select(key, F.col("share").alias("natural"))
    owed = given.join(all_before, "shard").select("shard", key, "all_before", "given").join(shares.select(key, "share"), "key").join(natural, "key")
    # a given target is kept by the windows of every shard until a source runs dry there; nothing is owed beyond that
    given_target = p.shares is not None or p.temper is not None
    carried = F.lit(0.0) if given_target else F.col("natural") * F.col("all_before") - F.col("given")
    carry = owed.select(F.col("shard").alias("of_shard"), F.col("key").alias("source"), "share", carried.alias("carry"))
    return placed.groupBy("shard").cogroup(carry.groupBy("of_shard")).applyInPandas(_pack(p), OUT)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """n_sequences, n_items, n_tokens, unused_share, largest_sequence."""
    per = packed.groupBy("shard", "sequence_no").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.round(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"), F.max("used").alias("largest_sequence"))


def mixture_report(packed: DataFrame, shares: DataFrame) -> DataFrame:
    """source, target_share, served_share, n_windows, worst_deviation: how well the windows keep to the target while every
    source of their shard still has items. worst_deviation: over all counts of windows from a shard's first, the largest
    difference between what the source got and its share, as a part of one window's tokens."""
    key = F.coalesce("source", F.lit(NULL_SOURCE)).alias("source")
    target = shares.select(key, "share").where("share > 0")
    per = packed.groupBy("shard", "window_no", key).agg(F.sum("n_tokens").alias("tokens")).join(target, "source")
    per = materialise(per, "mixture-windows")
    dry = per.groupBy("shard", "source").agg(F.max("window_no").alias("last")).groupBy("shard").agg(F.min("last").alias("dry"))
    full = per.join(dry, "shard").where("window_no < dry")
    # what all sources got up to a window, beside what this one got; a source that a window leaves out is met at its next
    all_ = full.groupBy("shard", "window_no").agg(F.sum("tokens").alias("all"))
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy("window_no")
    all_ = all_.withColumn("all_so_far", F.sum("all").over(up_to("shard")))
    mine = full.withColumn("so_far", F.sum("tokens").over(up_to("shard", "source"))).join(all_, ["shard", "window_no"])
    off = F.abs(F.col("so_far") - F.col("share") * F.col("all_so_far")) / F.col("all")
    by_source = mine.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_windows"), F.round(F.max(off), 4).alias("worst_deviation"))
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per source
    served = by_source.select("source", F.round(F.col("tokens") / whole, 6).alias("served_share"), "n_windows", "worst_deviation")
    out = target.join(served, "source", "left")
    return out.select(F.when(F.col("source") != NULL_SOURCE, F.col("source")).alias("source"), F.round("share", 6).alias("target_share"), "served_share", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), "worst_deviation")

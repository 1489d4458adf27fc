"""Near-duplicate records with small edits.

One 64-bit hash function turns a record into the sorted set of its shingle hashes; the bottom BOTTOM_K of them are its
sketch, the retained values. Lists of single values grow with the square of the table where shingles are common (the
README has figures), so a list is kept per run of four values that follow each other in the sketch: two sketches of
similar records are mostly the same values, and where four of them follow each other in both, they meet. Records of few
values retain all and have shorter runs, for which this is certain. Candidates are filtered by parity bits that travel
with the lists and then by the union of two sketches, which estimates the similarity; exact Jaccard of the full sets
verifies. A list of more than about HOT records is spread over salts. Of pairs at the threshold, runs miss about one in
ten thousand and the estimate turns away 3 in a million, and none of records with at most BOTTOM_K values.

Where there are few different shingles, as with three-character substrings, runs are too long lists as well: there a list is kept per group of `rows` values retained together under each of `lists` odd
multipliers of the hash; two records share one with probability 1 - (1 - s**rows)**lists, 0.9998 at the threshold.

Defined results: null texts, texts under the least size and rows without an id are in no pair; records with equal shingle sets are one
class, compared once; empty tables give empty results; a repeated id counts once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import HashMemo, codes, mix, signed, windows, words
from passagework.workspace import materialise

BOTTOM_K = 64
#: (values to a run, most values of the smaller record): from the first tier that holds the smaller of two records.
RUNS = ((1, 6), (2, 12), (3, 40), (4, 1 << 62))
#: Records to a salt of a list, and one record in so many of the sample that tells which lists are long.
HOT, SAMPLE = 2048, 64


@dataclass(frozen=True)
class Similar:
    """threshold in thousandths. lists: 0 for a list per run of retained values; else that many lists to a record, under as
    many multipliers, each of the bottom `rows` values."""

    threshold: int = 700
    rows: int = 4
    lists: int = 0


def word_shingles(size: int = 3, least_words: int = 20, short: bool = False) -> Callable[[], Callable[[str], np.ndarray]]:
    """Runs of `size` words; with `short`, all the words of a text that has fewer are its one shingle."""

    def make():
        memo = HashMemo()

        def of(text: str) -> np.ndarray:
            ws = words(text)
            if short and 0 < len(ws) < size:
                return windows(memo.of(ws), len(ws))
            return np.unique(windows(memo.of(ws), size)) if len(ws) >= max(size, least_words) else np.empty(0, np.uint64)

        return of

    return make


def char_shingles(size: int = 3, least_chars: int = 15) -> Callable[[], Callable[[str], np.ndarray]]:
    """Of the words joined by single blanks."""

    def make():
        def of(text: str) -> np.ndarray:
            c = codes(" ".join(words(text))).astype(np.uint64)
            return np.unique(windows(mix(c + np.uint64(1)), size)) if len(c) >= max(size, least_chars) else np.empty(0, np.uint64)

        return of

    return make


def list_keys(h: np.ndarray, rows: int, multipliers: np.ndarray) -> np.ndarray:
    """The inverted lists of one record: per multiplier, the hash of its bottom values."""
    r, out = min(rows, len(h)), []
    step = max(1, (1 << 18) // len(h))
    for s in range(0, len(multipliers), step):
        m = multipliers[s : s + step, None]
        g = (h ^ (h >> np.uint64(32)))[None, :] * m
        g = g ^ (g >> np.uint64(29))
        low = np.sort(np.partition(g, r - 1, axis=1)[:, :r], axis=1)
        k = m[:, 0].copy()
        for j in range(r):
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
        out.append(k)
    if len(h) <= 2 * rows:  # too few values to rely on groups of them
        out.append(mix(h))
    return np.concatenate(out)


def parity(h: np.ndarray) -> np.ndarray:
    """128 bits, each the parity of the values that fall on it. The bits in which two records differ are at most as many
    as the values that only one of them has."""
    return np.packbits((np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=128) & 1).astype(np.uint8)).view(np.int64)


def run_keys(s: np.ndarray, threshold: int) -> np.ndarray:
    """The lists of one record, of its hashes in order: runs of as many values as its size, and that of a similar record
    that may be smaller, ask for."""
    sketch, out, lowest = s[:BOTTOM_K].view(np.uint64), [], 0
    for length, most in RUNS:
        if lowest < len(s) <= most * 1000 // threshold:
            k = np.full(len(sketch) - length + 1, length, np.uint64)
            for j in range(length):
                k = k * np.uint64(0x9E3779B97F4A7C15) + sketch[j : j + len(k)]
            out.append(mix(k))
        lowest = most
    return np.concatenate(out)


FEATURES = "id long, set_key binary, n int, p0 long, p1 long, shingles array<long>, lists array<long>"


def _features(make: Callable[[], Callable[[str], np.ndarray]], how: Similar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = make()
        multipliers = np.random.default_rng(20).integers(0, 1 << 63, how.lists).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["body"]):
                h = of(text)
                if len(h):
                    s = np.sort(signed(h))
                    keys = list_keys(h, how.rows, multipliers) if how.lists else run_keys(s, how.threshold)
                    out.append((i, xxhash.xxh128_digest(s.tobytes()), len(s), *parity(h), s, signed(keys)))
            yield pd.DataFrame(out, columns=["id", "set_key", "n", "p0", "p1", "shingles", "lists"]).astype({"id": "int64", "n": "int32", "p0": "int64", "p1": "int64"})

    return run


def _meeting(posted: DataFrame) -> DataFrame:
    """a < b of records in one list, with what travels with them. Lists that a sample of one record in SAMPLE shows to be long are spread over salts:
    a record is in one of them as the first of a pair and in all as the second. How many there are changes the tasks, not
    the pairs."""
    seen = posted.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    hot = materialise(seen.where(F.col("seen") * SAMPLE >= HOT).select("key", F.ceil(F.col("seen") * SAMPLE / HOT).cast("int").alias("parts")), "near-hot")
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}{x}") for c in ("n", "p0", "p1")), F.col("id").alias(x))
    # both sides of the others are one and the same shuffle
    cold = posted if hot.isEmpty() else posted.join(hot.select("key"), "key", "left_anti")
    met = side(cold, "a").join(side(cold, "b"), "key").where(F.col("a") < F.col("b"))
    if cold is posted:
        return met
    few = posted.join(hot, "key")
    one, each = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # the hash of the salt joins the key, so that the sides keep their columns
    salted = lambda salt: few.select("id", "n", "p0", "p1", "key", salt.alias("salt")).withColumn("key", F.xxhash64("key", "salt"))
    return met.unionByName(side(salted(one), "a").join(side(salted(each), "b"), "key").where(F.col("a") < F.col("b")))


def similar_classes(records: DataFrame, shingles, how: Similar) -> tuple[DataFrame, DataFrame]:
    """records: id, body. Returns links and members. links: a < b, similarity: the pairs of classes at or over the
    threshold. members: id, class_id: records with equal shingle sets, class_id the least of their ids."""
    made = materialise(records.where("body is not null and id is not null").select("id", "body").mapInPandas(_features(shingles, how), FEATURES), "near-features")
    least = made.groupBy("set_key").agg(F.min("id").alias("class_id"))
    members = materialise(made.select("id", "set_key").distinct().join(least, "set_key").select("id", "class_id"), "near-members")
    # written, these small sides have a known size, and the planner need not shuffle the features to meet them
    copies = materialise(members.where("id <> class_id").select("id").distinct(), "near-copies")
    own = made.join(copies, "id", "left_anti")
    posted = own.select("id", "n", "p0", "p1", F.explode("lists").alias("key"))
    fits = (F.col("na") * 1000 >= F.col("nb") * how.threshold) & (F.col("nb") * 1000 >= F.col("na") * how.threshold)
    # records that differ in more bits than the threshold leaves values to differ in are not similar: no pair is lost
    differ = sum(F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in ("p0", "p1"))
    fits = fits & (differ * (1000 + how.threshold) <= (F.col("na") + F.col("nb")) * (1000 - how.threshold))
    met = materialise(_meeting(posted).where(fits).select("a", "b").distinct(), "near-met")
    used = materialise(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-used")
    sets = made.join(used, "id", "left_semi").dropDuplicates(["id"])
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    low = lambda x: F.slice(F.col(x), 1, BOTTOM_K)
    union = F.slice(F.sort_array(F.array_union(low("sa"), low("sb"))), 1, BOTTOM_K)
    common = F.array_intersect(F.array_intersect(low("sa"), low("sb")), union)
    t = how.threshold / 1000
    margin = t - 4.5 * math.sqrt(t * (1 - t) / BOTTOM_K)
    likely = both.where(F.size(common) >= margin * F.size(union))
    inter = F.size(F.array_intersect("sa", "sb"))
    exact = likely.select("a", "b", inter.alias("i"), (F.col("na") + F.col("nb") - inter).alias("u"))
    return exact.where(F.col("i") * 1000 >= F.col("u") * how.threshold).select("a", "b", (F.col("i") / F.col("u")).alias("similarity")), members


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """id_a < id_b of all similar records, those of one class among them."""
    a, b = members.select(F.col("id").alias("x"), F.col("class_id").alias("a")), members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    copies = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

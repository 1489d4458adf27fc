"""Long exact spans shared between records.

The paragraphs sketched here are all windows of `span` characters, since natural paragraphs do not delimit shared spans:
near_duplicate_paragraphs() bands those, and the README has the share of the true pairs that it meets. Of the hashes of
the K-character shingles in a window the MinHash, the least one, is kept as its band; equal windows have equal MinHash, so
no pair is lost, and neighbouring windows mostly share theirs, so a text keeps about 2 / (span - K + 2) of its positions.
A text keeps one position per MinHash, however often it repeats it. Texts that collide are verified character by character
along two diagonals and, where these are too short, by the hashes of all their windows; both take time in proportion to
the texts, whatever they repeat.

Defined results: null texts, texts shorter than the span and rows without an id share nothing; equal texts are compared once and expanded
at the end; characters are code points; a repeated id counts once per text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.components import components
from passagework.llm.neardup import Similar, similar_classes, word_shingles
from passagework.llm.words import char_windows, codes, signed
from passagework.workspace import materialise

SPAN, SHINGLE = 400, 300
#: A mark in so many places is replaced by the whole windows around it, which only texts with a common span share.
CROWDED = 256


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash, the rightmost of equals, of every window of `width` hashes."""
    if len(h) <= width:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.empty(0, int)
    # in blocks, so that very long texts take little memory
    out = []
    for s in range(0, len(h) - width + 1, 1 << 16):
        part = sliding_window_view(h[s : s + (1 << 16) + width - 1], width)[:, ::-1]
        out.append(np.unique(np.arange(len(part)) + width - 1 - part.argmin(1)) + s)
    return np.unique(np.concatenate(out))


MARKS = "text_id long, pos int, h long, first boolean"


def _sketch(span: int, shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, at, hs, new = [], [], [], []
            for i, text in zip(pdf["text_id"], pdf["text"]):
                h = char_windows(codes(text), shingle)
                p = minima(h, span - shingle + 1)
                first = np.zeros(len(p), bool)
                first[np.unique(h[p], return_index=True)[1]] = True
                new.append(first)
                ids.append(np.full(len(p), i, np.int64))
                at.append(p.astype(np.int32))
                hs.append(h[p])
            if ids:
                yield pd.DataFrame({"text_id": np.concatenate(ids), "pos": np.concatenate(at), "h": signed(np.concatenate(hs)), "first": np.concatenate(new)})

    return run


def longest_equal(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(start in a, length) of the longest equal run with position in b = position in a - offset."""
    s, e = max(0, offset), min(len(a), len(b) + offset)
    if e <= s:
        return 0, 0
    cuts = np.flatnonzero(np.concatenate([[True], a[s:e] != b[s - offset : e - offset], [True]]))
    gaps = np.diff(cuts)
    k = int(np.argmax(gaps))
    return s + int(cuts[k]), int(gaps[k]) - 1


def common_run(a: np.ndarray, b: np.ndarray, span: int) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest run that the first places of the windows common to both make up;
    length 0 if no window of `span` characters is common."""
    ha, pa = np.unique(char_windows(a, span), return_index=True)
    hb, pb = np.unique(char_windows(b, span), return_index=True)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0, 0, 0
    x, y = pa[ia], pb[ib]
    order = np.argsort(x)
    x, y = x[order], y[order]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1), [True]]))
    for k in np.argsort(-np.diff(cuts), kind="stable"):
        p, q, n = int(x[cuts[k]]), int(y[cuts[k]]), int(cuts[k + 1] - cuts[k]) + span - 1
        if np.array_equal(a[p : p + n], b[q : q + n]):  # hashes agree; so do the characters
            return n, p, q
    return 0, 0, 0


def _verify(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = codes(r.text_a), codes(r.text_b)
                best = (0, 0, 0)
                for d in {int(r.low), int(r.high)}:
                    p, n = longest_equal(a, b, d)
                    best = max(best, (n, p, p - d))
                if best[0] < span:
                    best = common_run(a, b, span)
                if best[0] >= span:
                    out.append((r.a, r.b, *best))
            yield pd.DataFrame(out, columns=["a", "b", "length", "start_a", "start_b"]).astype({"a": "int64", "b": "int64", "length": "int32", "start_a": "int32", "start_b": "int32"})

    return run


def _meeting(hits: DataFrame) -> DataFrame:
    """hits: h, text_id, pos, n (texts with h). a < b with the least and greatest difference of positions. A hash that many
    texts have is spread over n / CROWDED salts; the other side goes to each of them."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / CROWDED)).cast("int")
    a = hits.select("h", F.pmod(F.xxhash64("text_id"), parts).cast("int").alias("salt"), F.col("text_id").alias("a"), F.col("pos").alias("pa"))
    b = hits.select("h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("text_id").alias("b"), F.col("pos").alias("pb"))
    off = F.col("pa") - F.col("pb")
    return a.join(b, ["h", "salt"]).where("a < b").groupBy("a", "b").agg(F.min(off).alias("low"), F.max(off).alias("high"))


def shared_spans(documents: DataFrame, span: int = SPAN, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: text_id_a < text_id_b, length, start_a, start_b: a verbatim span of each pair of
    different texts that share `span` characters or more, the longest where neither text repeats itself. members: doc_id, text_id."""
    leaders = _leaders(documents, span)
    texts = documents.select("doc_id", "text").join(leaders.where("doc_id = text_id").select("doc_id", "text_id"), "doc_id").select("text_id", "text")
    marks = materialise(texts.mapInPandas(_sketch(span, shingle), MARKS), "span-marks")
    # a mark met in one text only links nothing: both ends of the range are combined before the shuffle
    once = marks.where("first").drop("first")  # a text's first place of a mark
    shared = once.groupBy("h").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").where(F.col("n") < CROWDED).select("h", "n")
    hits = once.join(shared, "h").unionByName(_crowded_hits(texts, marks, span, shingle))
    pairs = materialise(_meeting(hits), "span-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct()
    needed = materialise(texts.join(used, "text_id"), "span-texts")
    side = lambda x: needed.select(F.col("text_id").alias(x), F.col("text").alias(f"text_{x}"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_verify(span), "a long, b long, length int, start_a int, start_b int")
    return checked.select(F.col("a").alias("text_id_a"), F.col("b").alias("text_id_b"), "length", "start_a", "start_b"), leaders


def _crowded_hits(texts: DataFrame, marks: DataFrame, span: int, shingle: int) -> DataFrame:
    """text_id, pos, h, n of every window of `span` characters around a crowded mark: a passage that is shorter than the span
    brings no pairs together, however many texts have it, and none that share a span are lost."""
    crowded = marks.where("first").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWDED).select("h")
    at = materialise(marks.join(crowded, "h").groupBy("text_id").agg(F.collect_set("pos").alias("marks")), "span-crowded")
    if at.isEmpty():
        return marks.drop("first").withColumn("n", F.lit(0).cast("long")).limit(0)
    found = materialise(texts.join(at, "text_id").mapInPandas(_span_hashes(span, shingle, once=True), "text_id long, p int, h long"), "span-crowded-windows")
    twice = found.groupBy("h").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "n")
    return found.join(twice, "h").select("text_id", F.col("p").alias("pos"), "h", "n")


def _leaders(documents: DataFrame, span: int) -> DataFrame:
    """doc_id, text_id, n_chars: text_id is the least doc_id with an equal text. Only hashes are shuffled."""
    long = documents.where((F.length("text") >= span) & F.col("doc_id").isNotNull()).select("doc_id", F.sha2("text", 256).alias("key"), F.length("text").alias("n_chars"))
    least = long.groupBy("key").agg(F.min("doc_id").alias("text_id"))
    return materialise(long.distinct().join(least, "key").select("doc_id", "text_id", "n_chars"), "span-leaders")


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of all records that share a span, copies of a text among them."""
    m = members.select("doc_id", "text_id")
    a, b = m.select(F.col("doc_id").alias("x"), F.col("text_id").alias("text_id_a")), m.select(F.col("doc_id").alias("y"), F.col("text_id").alias("text_id_b"))
    across = links.select("text_id_a", "text_id_b").join(a, "text_id_a").join(b, "text_id_b").select("x", "y")
    copies = a.join(b, F.col("text_id_a") == F.col("text_id_b")).where("x < y").select("x", "y")
    both = across.unionByName(copies)
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def _span_hashes(span: int, shingle: int, once: bool = False):
    """The windows that hold a colliding shingle, with `once` only the first of equal ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text, at in zip(pdf["text_id"], pdf["text"], pdf["marks"]):
                h = char_windows(codes(text), span)
                steps = np.zeros(len(h) + span, np.int32)
                np.add.at(steps, np.maximum(0, np.asarray(at) - (span - shingle)), 1)
                np.add.at(steps, np.asarray(at) + 1, -1)
                p = np.flatnonzero(np.cumsum(steps)[: len(h)] > 0)
                if once:
                    p = p[np.sort(np.unique(h[p], return_index=True)[1])]
                yield pd.DataFrame({"text_id": np.full(len(p), i, np.int64), "p": p.astype(np.int32), "h": signed(h[p])})

    return run


def shared_share(documents: DataFrame, span: int = SPAN, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, shared_chars for every record that shares a span: the characters inside some window of `span`
    characters that another record has too. No pair of records is formed, however many share a window: windows near a
    shared mark are counted by hash, and neighbours in order of position give the covered length."""
    leaders = _leaders(documents, span)
    copies = leaders.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_id")
    texts = documents.select("doc_id", "text").join(leaders.where("doc_id = text_id").select("doc_id", "text_id"), "doc_id").select("text_id", "text")
    marks = materialise(texts.mapInPandas(_sketch(span, shingle), MARKS), "share-marks")
    shared = marks.groupBy("h").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo < hi").select("h")
    hits = materialise(marks.join(shared, "h").groupBy("text_id").agg(F.collect_set("pos").alias("marks")), "share-hits")
    found = materialise(texts.join(hits, "text_id").mapInPandas(_span_hashes(span, shingle), "text_id long, p int, h long"), "share-windows")
    twice = found.groupBy("h").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo < hi").select("h")
    own = found.join(twice, "h").select("text_id", "p").distinct()
    ahead = F.lead("p").over(Window.partitionBy("text_id").orderBy("p")) - F.col("p")
    part = own.withColumn("n", F.least(F.lit(span), F.coalesce(ahead, F.lit(span)))).groupBy("text_id").agg(F.sum("n").alias("part"))
    full = leaders.join(copies.withColumn("copied", F.lit(True)), "text_id", "left").join(part, "text_id", "left")
    covered = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("part"))
    return full.where("copied or part is not null").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), covered.cast("long").alias("shared_chars"))


#: Word shingles of five and a similarity of 0.8 in bands of five; 1 - (1 - 0.8**5)**28 = 0.99998 of the pairs at it collide.
PARAGRAPHS = Similar(threshold=800, rows=5, lists=28)


def natural_paragraphs(documents: DataFrame) -> DataFrame:
    """id, doc_id, no, body: the parts between blank lines that are not blank. `id` is the row's place in the written table."""
    parts = F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n[ \t]*\n")
    each = documents.where("text is not null and doc_id is not null").select("doc_id", F.posexplode(parts).alias("no", "body"))
    return materialise(each.where(F.col("body").rlike(r"\S")).select(F.monotonically_increasing_id().alias("id"), "doc_id", "no", "body"), "paragraphs")


def near_duplicate_paragraphs(documents: DataFrame, how: Similar = PARAGRAPHS) -> DataFrame:
    """doc_id, n_paragraphs, n_repeats, repeated_chars of every document: natural paragraphs that repeat one of another
    place. Their bands collide, exact Jaccard verifies and connected components cluster; paragraphs of fewer than five words
    repeat if their words are the same, without words never. The paragraph of the least document and position stays in each
    group, all others are repeats."""
    paragraphs = natural_paragraphs(documents)
    links, members = similar_classes(paragraphs.select("id", "body"), word_shingles(5, 1, short=True), how)
    groups = components(links).withColumnRenamed("id", "class_id")
    grouped = members.join(groups, "class_id", "left").select("id", F.coalesce("component", "class_id").alias("group_id"))
    placed = materialise(paragraphs.select("id", "doc_id", "no", F.length("body").alias("n")).join(grouped, "id", "left"), "paragraph-groups")
    keep = placed.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "no")).alias("keep"))
    repeats = placed.join(keep, "group_id", "left").withColumn("repeat", F.coalesce(F.col("keep") != F.struct("doc_id", "no"), F.lit(False)))
    counted = repeats.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if("repeat").alias("n_repeats"), F.coalesce(F.sum(F.when(F.col("repeat"), F.col("n"))), F.lit(0)).alias("repeated_chars"))
    all_ = documents.where("doc_id is not null").select("doc_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_.join(counted, "doc_id", "left").select("doc_id", zero("n_paragraphs"), zero("n_repeats"), zero("repeated_chars"))


def paragraph_pairs(documents: DataFrame, how: Similar = PARAGRAPHS) -> DataFrame:
    """doc_id_a < doc_id_b of documents that have natural paragraphs in one similar pair or class: what banding over natural
    paragraphs alone can find of the documents that share a long span. Used to measure it."""
    paragraphs = natural_paragraphs(documents)
    links, members = similar_classes(paragraphs.select("id", "body"), word_shingles(5, 1, short=True), how)
    of = members.join(paragraphs.select("id", "doc_id"), "id").select("class_id", "doc_id").distinct()
    same = links.select("a", "b").unionByName(of.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).distinct())
    pairs = same.join(of.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x")), "a").join(of.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y")), "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

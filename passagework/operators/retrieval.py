"""Keyword search, vector search, rank fusion and their combination, for one caller or for a table of requests.

A table of requests is answered in bounded blocks: a block of requests is sent to the executors, every batch of chunks
is scored against it in one go, a task keeps its best k per request, and only those meet in the ranking window. The
chunks are read once per block and never shuffled. The access list is applied in the scorer, below the top k.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.functions import vectors as vx
from passagework.functions.access import Request, scoped
from passagework.workspace import spread

#: Candidates per retriever, after fusion and in the answer; the constant of rank fusion; weights of words.
RETRIEVER_LIMIT, FUSED_LIMIT, FINAL_LIMIT, RRF_K = 50, 30, 6, 60
#: In tenths, so that sums are exact.
SECTION_WEIGHT, CONTENT_WEIGHT = 10, 4
#: Requests answered in one pass over the chunks; bounds what is broadcast.
REQUEST_BLOCK = 2048


# --- queries as boolean trees -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # more than one: a phrase
    negated: bool = False


@dataclass(frozen=True)
class KeywordQuery:
    terms: tuple[Term, ...]
    conjunctive: bool  # only a query that excludes something keeps "and"

    @property
    def matches_nothing(self) -> bool:
        return not any(not t.negated for t in self.terms)


_PART = re.compile(r'(?P<neg>(?:(?<=\s)|^)-)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s"]+))')
_WORD = re.compile(r"[^\W_]+")


def parse_query(text: str) -> KeywordQuery:
    """Words, "phrases" and -exclusions; stop words are dropped."""
    stop, terms = frozenset(tx.INDEX_STOP_WORDS), []
    for m in _PART.finditer(text or ""):
        found = tuple(w for w in (x.lower() for x in _WORD.findall(m["phrase"] if m["phrase"] is not None else m["word"])) if w not in stop)
        if not found or (m["word"] and m["word"].lower() == "or" and not m["neg"]):
            continue
        groups = [found] if m["phrase"] is not None or m["neg"] else [(w,) for w in found]
        terms += [Term(g, bool(m["neg"])) for g in groups]
    return KeywordQuery(tuple(dict.fromkeys(terms)), any(t.negated for t in terms))


def matches(query: KeywordQuery, lexemes: Column) -> Column:
    """The boolean tree over a chunk's list of lexemes in order."""
    if query.matches_nothing:
        return F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(lexemes, " "), F.lit(" "))
    has = lambda t: F.array_contains(lexemes, t.words[0]) if len(t.words) == 1 else joined.contains(f" {' '.join(t.words)} ")
    if query.conjunctive:
        out = F.lit(True)
        for t in query.terms:
            out &= ~has(t) if t.negated else has(t)
        return out
    out = F.lit(False)
    for t in query.terms:
        out |= has(t)
    return out


def keyword_score(section: Column, content: Column, words: Column) -> Column:
    """Weights of the positions that match, over all positions, brought under one. section, content: lexemes."""
    hits = lambda c: F.size(F.filter(c, lambda w: F.array_contains(words, w)))
    raw = hits(section) * SECTION_WEIGHT + hits(content) * CONTENT_WEIGHT
    positions = (F.size(section) + F.size(content)) * 10
    return F.when(positions > 0, raw / (raw + positions)).otherwise(0.0)


# --- one caller ---------------------------------------------------------------------------------------------------------


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """chunk_id, score, rank of one request: ties go to the lesser id."""
    top = scores.orderBy(F.desc("score"), "chunk_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def search_keyword(chunks: DataFrame, request: Request) -> DataFrame:
    query = parse_query(request.text)
    if request.sees_nothing or query.matches_nothing:
        return chunks.sparkSession.createDataFrame([], "chunk_id long, score double, rank int")
    words = F.array(*(F.lit(w) for w in dict.fromkeys(w for t in query.terms if not t.negated for w in t.words)))
    own = scoped(chunks, request).select("chunk_id", tx.lexemes(F.coalesce("section_path", F.lit(""))).alias("s"), tx.lexemes(F.coalesce("content", F.lit(""))).alias("c"))
    hit = own.where(matches(query, F.concat("s", "c")))
    return ranked(hit.select("chunk_id", F.round(keyword_score(F.col("s"), F.col("c"), words), 6).alias("score")), request.limit)


def search_vector(chunks: DataFrame, request: Request, vector: list[float]) -> DataFrame:
    if request.sees_nothing:
        return chunks.sparkSession.createDataFrame([], "chunk_id long, score double, rank int")
    v = F.array(*(F.lit(float(x)) for x in vector))
    own = scoped(chunks, request).where(F.col("embedding").isNotNull() & (F.size("embedding") == len(vector)))
    return ranked(own.select("chunk_id", F.round(vx.cosine(F.col("embedding"), v), 6).alias("score")).where("score is not null"), request.limit)


# --- a table of requests ----------------------------------------------------------------------------------------------

TOP = "request_id string, chunk_id long, score double"


def _best_of(kept: tuple | None, new: tuple, k: int) -> tuple:
    """(row of the request, chunk id, score): the k best of each request of both; ties go to the lesser id."""
    if kept is None:
        return new
    row, ids, scores = (np.concatenate(x) for x in zip(kept, new))
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[place < k], ids[place < k], scores[place < k]


def _top_of_batch(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """scores (requests, chunks), -inf where not allowed. (row, id, score) of the k best of each row; of equal scores the
    lesser ids."""
    take = min(k, scores.shape[1])
    order = np.argsort(ids, kind="stable")  # a stable descending sort then leaves the lesser id first
    scores, ids = scores[:, order], ids[order]
    top = np.argsort(-scores, axis=1, kind="stable")[:, :take] if scores.shape[1] <= 4 * take else _best(scores, take)
    s = np.take_along_axis(scores, top, 1)
    keep = np.isfinite(s)
    return np.repeat(np.arange(len(scores)), take)[keep.ravel()], ids[top][keep], s[keep]


def _best(scores: np.ndarray, take: int) -> np.ndarray:
    bound = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
    out = np.empty((len(scores), take), np.int64)
    for r in range(len(scores)):
        above = np.flatnonzero(scores[r] > bound[r])
        level = np.flatnonzero(scores[r] == bound[r])[: take - len(above)]
        out[r] = np.concatenate([above, level])
    return out


def _blocks(requests: DataFrame) -> Iterator[pd.DataFrame]:
    """Bounded parts of the requests, on the driver."""
    n = requests.count()
    parts = max(1, math.ceil(n / REQUEST_BLOCK * 1.2)) if n > REQUEST_BLOCK else 1
    for b in range(parts):
        part = requests.where(F.pmod(F.xxhash64("request_id"), F.lit(parts)) == b) if parts > 1 else requests
        pdf = part.toPandas()
        if len(pdf):
            yield pdf


def _allowed(acl: pd.Series, groups: list) -> np.ndarray:
    """(requests, chunks): both sides are few distinct lists."""
    akeys, acode = np.unique([",".join(map(str, sorted(set(x)))) if x is not None else "" for x in acl], return_inverse=True)
    gkeys, gcode = np.unique([",".join(map(str, sorted(set(x)))) if x is not None else "" for x in groups], return_inverse=True)
    sets = lambda keys: [set(k.split(",")) - {""} for k in keys]
    small = np.array([[bool(g & a) for a in sets(akeys)] for g in sets(gkeys)], bool).reshape(len(gkeys), len(akeys))
    return small[np.ix_(gcode, acode)]


def _answer(chunks: DataFrame, requests: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], limit: int) -> DataFrame:
    spark, out, chunks = chunks.sparkSession, None, spread(chunks)
    for block in _blocks(requests):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked = shared.value
            groups, kept = asked["group_ids"].tolist(), None
            for pdf in batches:
                if not len(pdf):
                    continue
                s = score(asked, pdf)
                s[~_allowed(pdf["access_group_ids"], groups)] = -np.inf
                kept = _best_of(kept, _top_of_batch(s, pdf["chunk_id"].to_numpy(), limit), limit)
            if kept is not None:
                row, ids, scores = kept
                yield pd.DataFrame({"request_id": asked["request_id"].to_numpy()[row], "chunk_id": ids, "score": scores})

        part = chunks.mapInPandas(run, TOP)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], TOP)
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _round6(x: np.ndarray) -> np.ndarray:
    """Half up, as in SQL."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def _keyword_scores(asked: pd.DataFrame, pdf: pd.DataFrame) -> np.ndarray:
    by_word = defaultdict(list)
    for r, ws in enumerate(asked["lexemes"]):
        for w in set(ws if ws is not None else ()):
            by_word[w].append(r)
    rows = {w: np.array(v) for w, v in by_word.items()}
    stop = frozenset(tx.INDEX_STOP_WORDS)
    out, places = np.zeros((len(pdf), len(asked))), np.ones((len(pdf), 1))  # a chunk's row is written in one place
    for j, (section, content) in enumerate(zip(pdf["section_path"], pdf["content"])):
        weights, n = defaultdict(int), 0
        for text, weight in ((section, SECTION_WEIGHT), (content, CONTENT_WEIGHT)):
            for w in _WORD.findall((text or "").lower()):
                if w not in stop:
                    n += 1
                    if w in rows:
                        weights[w] += weight
        for w, x in weights.items():
            out[j, rows[w]] += x
        places[j] = max(1, n) * 10
    scores = _round6(out / (out + places))
    scores[out == 0] = -np.inf
    return np.ascontiguousarray(scores.T)


def keyword_topk(chunks: DataFrame, requests: DataFrame, limit: int = RETRIEVER_LIMIT) -> DataFrame:
    """requests: request_id, question, group_ids. request_id, chunk_id, score, rank."""
    asked = requests.select("request_id", "group_ids", tx.lexemes(F.col("question")).alias("lexemes"))
    return _answer(chunks.select("chunk_id", "access_group_ids", "section_path", "content"), asked, _keyword_scores, limit)


def keyword_matches(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, n_chunks: how many visible chunks match any word. Counted batch by batch; no pair leaves a task."""
    asked = requests.select("request_id", "group_ids", tx.lexemes(F.col("question")).alias("lexemes"))
    own, out = spread(chunks.select("chunk_id", "access_group_ids", "section_path", "content")), None
    for block in _blocks(asked):
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            b = shared.value
            for pdf in batches:
                if len(pdf):
                    hit = np.isfinite(_keyword_scores(b, pdf)) & _allowed(pdf["access_group_ids"], b["group_ids"].tolist())
                    yield pd.DataFrame({"request_id": b["request_id"], "n": hit.sum(1).astype(np.int64)})

        part = own.mapInPandas(run, "request_id string, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "request_id string, n_chunks long")
    return out.groupBy("request_id").agg(F.sum("n").alias("n_chunks"))


def _vector_scores(asked: pd.DataFrame, pdf: pd.DataFrame) -> np.ndarray:
    q = np.stack(asked["vector"].to_numpy()).astype(np.float64)
    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = _round6((q @ x.T) / n)
    s[~np.isfinite(s)] = -np.inf
    return s


def vector_topk(chunks: DataFrame, requests: DataFrame, limit: int = RETRIEVER_LIMIT, dim: int = 64) -> DataFrame:
    """requests: request_id, vector, group_ids. Exact cosine; request_id, chunk_id, score, rank."""
    usable = chunks.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda e: e.isNull()))
    return _answer(usable.select("chunk_id", "access_group_ids", "embedding"), requests.where(F.size("vector") == dim).select("request_id", "group_ids", "vector"), _vector_scores, limit)


def fuse(keyword: DataFrame, vector: DataFrame, limit: int = FUSED_LIMIT, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: every list a chunk is in adds 1 / (k + rank). The lists' own ranks and scores are kept."""
    if k < 1:
        raise ValueError("k must be at least 1")
    both = keyword.withColumn("kind", F.lit("keyword")).unionByName(vector.withColumn("kind", F.lit("vector")))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    fused = both.groupBy("request_id", "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("rrf_score"),
        *(pick(kind, c).alias(f"{kind}_{c}") for kind in ("keyword", "vector") for c in ("rank", "score")),
    )
    w = Window.partitionBy("request_id").orderBy(F.desc("rrf_score"), "chunk_id")
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def provenance() -> Column:
    return F.array_compact(F.array(F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")))


def final_score(rerank: Column | None = None) -> Column:
    """The score of the last stage that gave one; a vector score of exactly 0 counts as none."""
    parts = [rerank] if rerank is not None else []
    return F.coalesce(*parts, F.col("rrf_score"), F.nullif(F.col("vector_score"), F.lit(0.0)), F.col("keyword_score"), F.lit(0.0))


def rerank(fused: DataFrame, score: Column | None, top_n: int) -> DataFrame:
    """Orders by another score; without one the fused order stays."""
    if score is None:
        return fused.where(F.col("position") <= top_n)
    scored = fused.withColumn("rerank_score", score)
    w = Window.partitionBy("request_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n)


def hybrid(chunks: DataFrame, requests: DataFrame, limit: int = FINAL_LIMIT, retriever_limit: int = RETRIEVER_LIMIT) -> DataFrame:
    """requests: request_id, question, vector, group_ids. The final candidates; chunks' content is joined on by the caller,
    when only `limit` rows per request are left. The access list is looked at again here."""
    fused = fuse(keyword_topk(chunks, requests, retriever_limit), vector_topk(chunks, requests, retriever_limit))
    own = fused.join(requests.select("request_id", "group_ids"), "request_id").join(chunks.select("chunk_id", "access_group_ids"), "chunk_id")
    safe = own.where(F.coalesce(F.arrays_overlap("access_group_ids", "group_ids"), F.lit(False))).drop("group_ids", "access_group_ids")
    return safe.where(F.col("position") <= limit)


def candidates(chunks: DataFrame, documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the columns that are shown, fetched after ranking: only chunks that were hit are joined."""
    cols = ["chunk_id", "doc_id", "chunk_index", "section_path", "content", "department", "doc_type", "classification", "source_updated_at"]
    docs = documents.select("doc_id", F.col("title").alias("document_title"), "source", "source_uri")
    return hits.join(chunks.select(*cols), "chunk_id").join(docs, "doc_id", "left")


def rerank_with_model(fused: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], top_n: int) -> DataFrame:
    """fused: request_id, chunk_id, position, question, passage. Orders by a model's scores; where the model fails for any
    candidate of a request, that request keeps its fused order (rerank_score null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = make()
        except Exception:  # noqa: BLE001 - a model that cannot be loaded must not stop search
            model = None
        for pdf in batches:
            try:
                scores = model(list(zip(pdf["question"], pdf["passage"]))) if model else [None] * len(pdf)
            except Exception:  # noqa: BLE001
                scores = [None] * len(pdf)
            yield pdf[["request_id", "chunk_id", "position"]].assign(rerank_score=pd.Series(scores, dtype="float64", index=pdf.index))

    own = fused.select("request_id", "chunk_id", F.col("position").cast("int").alias("position"), "question", "passage")
    scored = own.mapInPandas(run, "request_id string, chunk_id long, position int, rerank_score double")
    failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("request_id"))
    scored = scored.withColumn("rerank_score", F.when(~failed, F.col("rerank_score")))
    w = Window.partitionBy("request_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.when(F.col("rerank_score").isNull(), F.col("position")), "chunk_id")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n)

"""Search queries: the held-out questions, each asked by its user, over all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.functions.access import Request, may_see
from passagework.operators import retrieval as rt
from passagework.workspace import materialise, table

MODEL = "nw-embed-2"


def callers(spark: SparkSession, d: str) -> DataFrame:
    """email, group_ids: one row per address, whatever its letter case; the first user of an address counts."""
    users = table(spark, d, "users").withColumn("email", tx.normal_email(F.col("email")))
    return users.where("email is not null").groupBy("email").agg(F.min_by("group_ids", "user_id").alias("group_ids"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """request_id, question, group_ids, vector. A question has no vector in the tables: it takes that of the first usable
    chunk of the documents it is about, and where there is none that of row n modulo their number in `embeddings`."""
    cases = table(spark, d, "eval_cases").select(F.col("case_id").alias("request_id"), "question", tx.normal_email(F.col("asked_by")).alias("email"), F.regexp_extract("case_id", r"(\d+)$", 1).cast("long").alias("n"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    count = vectors.count()
    asked = cases.join(callers(spark, d), "email", "left")
    about = table(spark, d, "eval_cases").select(F.col("case_id").alias("request_id"), F.explode("expected_sources").alias("source_uri")).join(table(spark, d, "documents").select("source_uri", "doc_id"), "source_uri")
    usable = current(chunks(spark, d)).where((F.size("embedding") == 64) & usable_vector("embedding")).select("doc_id", "chunk_id", "embedding")
    own = about.join(usable, "doc_id").groupBy("request_id").agg(F.min_by("embedding", "chunk_id").alias("own"))
    full = asked.withColumn("vec_id", F.col("n") % count).join(vectors, "vec_id", "left").join(own, "request_id", "left")
    # written once: it is counted, sent to the executors and joined
    return materialise(full.select("request_id", "question", "group_ids", F.coalesce("own", "vector").alias("vector")), "requests")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def current(df: DataFrame) -> DataFrame:
    """Chunks whose vector is of the model in use."""
    return df.where(F.col("embedding_model") == MODEL)


def usable_vector(column: str):
    """Every component there and finite, not all of them zero."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return ~F.exists(column, bad) & F.exists(column, lambda e: e != 0)


def keyword_rank_topk(spark, d):
    return rt.keyword_topk(chunks(spark, d), requests(spark, d)).select("request_id", "chunk_id", "rank", "score")


def vector_topk_acl_filtered(spark, d):
    return rt.vector_topk(current(chunks(spark, d)), requests(spark, d)).select("request_id", "chunk_id", "rank", "score")


def vector_topk_exact(spark, d):
    """Without access lists: every caller is taken to be in every group."""
    everyone = table(spark, d, "access_groups").agg(F.sort_array(F.collect_set("group_id"))).first()[0]
    open_to_all = current(chunks(spark, d)).withColumn("access_group_ids", F.array(*map(F.lit, everyone)))
    asked = requests(spark, d).withColumn("group_ids", F.array(*map(F.lit, everyone)))
    return rt.vector_topk(open_to_all, asked, 10).select("request_id", "chunk_id", "rank", "score")


def _fused(spark, d):
    asked, all_chunks = requests(spark, d), chunks(spark, d)
    return rt.fuse(rt.keyword_topk(all_chunks, asked), rt.vector_topk(current(all_chunks), asked))


def rrf_fuse(spark, d):
    return _fused(spark, d).select("request_id", "chunk_id", "position", "rrf_score")


def rrf_provenance(spark, d):
    return _fused(spark, d).select("request_id", "chunk_id", F.array_join(rt.provenance(), "+").alias("retrieved_by"), "keyword_rank", "vector_rank")


def final_score_coalesce(spark, d):
    return _fused(spark, d).select("request_id", "chunk_id", rt.final_score().alias("final_score"))


def vector_max_similarity_gate(spark, d):
    """The best similarity among the fused candidates, none counting as 0, against the threshold."""
    best = _fused(spark, d).groupBy("request_id").agg(F.coalesce(F.max(F.coalesce("vector_score", F.lit(0.0))), F.lit(0.0)).alias("best"))
    return requests(spark, d).select("request_id").join(best, "request_id", "left").select("request_id", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= 0.60).alias("answerable"))


def hybrid_hits(spark, d, limit=rt.FINAL_LIMIT):
    asked, all_chunks = requests(spark, d), chunks(spark, d)
    fused = rt.fuse(rt.keyword_topk(all_chunks, asked), rt.vector_topk(current(all_chunks), asked))
    seen = fused.where(F.col("position") <= limit).join(asked.select("request_id", "group_ids"), "request_id").join(all_chunks.select("chunk_id", "access_group_ids"), "chunk_id")
    return seen.where(may_see(F.col("access_group_ids"), F.col("group_ids"))).drop("group_ids", "access_group_ids")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    out = rt.candidates(chunks(spark, d), table(spark, d, "documents"), hybrid_hits(spark, d))
    return out.select("request_id", "position", "chunk_id", "doc_id", "document_title", "source_uri", "section_path", "rrf_score")


def hybrid_filtered(spark, d):
    """Within internal and public documents of two departments."""
    asked = requests(spark, d)
    within = chunks(spark, d).where(F.col("department").isin("engineering", "finance") & F.col("classification").isin("internal", "public"))
    fused = rt.fuse(rt.keyword_topk(within, asked), rt.vector_topk(current(within), asked))
    return fused.where(F.col("position") <= rt.FINAL_LIMIT).select("request_id", "chunk_id", "position", "rrf_score")


def rerank_identity(spark, d):
    return rt.rerank(_fused(spark, d), None, rt.FINAL_LIMIT).select("request_id", "chunk_id", "position")


def rerank_scored_topn(spark, d):
    """By a score of question and content: the part of the question's words that the content has."""
    fused = _fused(spark, d).join(requests(spark, d).select("request_id", "question"), "request_id").join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    score = F.round(tx.share_of(F.array_distinct(tx.lexemes(F.col("question"))), F.array_distinct(tx.lexemes(F.col("content")))), 6)
    return rt.rerank(fused, score, rt.FINAL_LIMIT).select("request_id", "chunk_id", "position", "rerank_score")


def _keyword(spark, d, text):
    groups = tuple(r[0] for r in table(spark, d, "access_groups").select("group_id").orderBy("group_id").collect())
    return rt.search_keyword(chunks(spark, d), Request(text, groups)).select("chunk_id", "score", "rank")


def keyword_negation_and(spark, d):
    return _keyword(spark, d, "purchase order -invoice")


def keyword_phrase(spark, d):
    return _keyword(spark, d, '"latency budget" -quarterly')


def keyword_match_or(spark, d):
    """How many of the chunks that the caller may see match any word of each question."""
    return rt.keyword_matches(chunks(spark, d), requests(spark, d)).where("n_chunks > 0")


# --- SQL ----------------------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.INDEX_STOP_WORDS) + "]"
LEX = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w))"
USABLE = lambda e: f"len(list_filter({e}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({e}, lambda x: x <> 0)) > 0"
REQUESTS = f"""
callers AS (SELECT lower(trim(email)) AS email, arg_min(group_ids, user_id) AS group_ids FROM users WHERE trim(email) <> '' GROUP BY 1),
own AS (
  SELECT case_id, arg_min(c.embedding, c.chunk_id) AS v FROM (SELECT case_id, unnest(expected_sources) AS u FROM eval_cases) x JOIN documents d ON d.source_uri = x.u JOIN chunks c ON c.doc_id = d.doc_id
  WHERE c.embedding_model = '{MODEL}' AND len(c.embedding) = 64 AND {USABLE("c.embedding")} GROUP BY 1),
req AS (
  SELECT c.case_id AS request_id, c.question, u.group_ids, coalesce(o.v, e.embedding) AS vector
  FROM eval_cases c LEFT JOIN callers u ON u.email = lower(trim(c.asked_by))
  LEFT JOIN embeddings e ON e.vec_id = CAST(regexp_extract(c.case_id, '(\\d+)$', 1) AS BIGINT) % (SELECT count(*) FROM embeddings)
  LEFT JOIN own o ON o.case_id = c.case_id)"""


def _kw(where: str = "true", limit: int = 50) -> str:
    return f"""
pos AS (
  SELECT chunk_id, access_group_ids, unnest({LEX("section_path")}) AS lexeme, 10 AS w FROM chunks WHERE {where}
  UNION ALL SELECT chunk_id, access_group_ids, unnest({LEX("content")}), 4 FROM chunks WHERE {where}),
npos AS (SELECT chunk_id, count(*) AS n FROM pos GROUP BY 1),
tf AS (SELECT chunk_id, lexeme, any_value(access_group_ids) AS access_group_ids, sum(w) AS w FROM pos GROUP BY 1, 2),
qlex AS (SELECT DISTINCT request_id, group_ids, unnest({LEX("question")}) AS lexeme FROM req),
kraw AS (SELECT request_id, t.chunk_id, CAST(sum(t.w) AS DOUBLE) AS r, any_value(n.n) * 10 AS p FROM qlex q JOIN tf t USING (lexeme) JOIN npos n ON n.chunk_id = t.chunk_id WHERE list_has_any(t.access_group_ids, q.group_ids) GROUP BY 1, 2),
ksc AS (SELECT request_id, chunk_id, round(r / (r + p), 6) AS score FROM kraw),
kw AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM ksc QUALIFY rank <= {limit})"""


def _vec(where: str = "true", limit: int = 50, acl: str = "list_has_any(c.access_group_ids, q.group_ids)") -> str:
    return f"""
vch AS (SELECT chunk_id, access_group_ids, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE len(embedding) = 64 AND embedding_model = 'nw-embed-2' AND {USABLE("embedding")} AND {where}),
vsc AS (SELECT request_id, chunk_id, round(list_cosine_similarity(e, CAST(q.vector AS DOUBLE[])), 6) AS score FROM req q JOIN vch c ON {acl} WHERE q.vector IS NOT NULL),
vec AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM vsc QUALIFY rank <= {limit})"""


_FUSED = """
fus0 AS (
  SELECT request_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, max(CASE WHEN kind = 'k' THEN rank END) AS keyword_rank, max(CASE WHEN kind = 'k' THEN score END) AS keyword_score,
    max(CASE WHEN kind = 'v' THEN rank END) AS vector_rank, max(CASE WHEN kind = 'v' THEN score END) AS vector_score
  FROM (SELECT *, 'k' AS kind FROM kw UNION ALL SELECT *, 'v' FROM vec) GROUP BY 1, 2),
fus AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rrf_score DESC, chunk_id) AS position FROM fus0 QUALIFY position <= 30)"""
ALL = f"WITH {REQUESTS}, {_kw()}, {_vec()}, {_FUSED}"
_WITHIN = "department IN ('engineering', 'finance') AND classification IN ('internal', 'public')"


def _boolean(cond: str, words: list[str]) -> str:
    ws = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    hits = lambda c: f"len(list_filter({c}, lambda x: list_contains({ws}, x)))"
    return f"""
WITH l AS (SELECT chunk_id, coalesce({LEX("section_path")}, []) AS s, coalesce({LEX("content")}, []) AS c FROM chunks WHERE list_has_any(access_group_ids, (SELECT list(group_id) FROM access_groups))),
m AS (SELECT chunk_id, s, c, list_concat(s, c) AS a, ' ' || array_to_string(list_concat(s, c), ' ') || ' ' AS t FROM l),
r AS (SELECT chunk_id, CAST({hits("s")} * 10 + {hits("c")} * 4 AS DOUBLE) AS r, len(a) * 10 AS p FROM m WHERE {cond}),
x AS (SELECT chunk_id, round(r / (r + p), 6) AS score FROM r)
SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 50"""


QUERIES = {f.__name__: f for f in (hybrid_search, hybrid_filtered, keyword_rank_topk, keyword_match_or, keyword_negation_and, keyword_phrase, vector_topk_exact, vector_topk_acl_filtered, vector_max_similarity_gate, rrf_fuse, rrf_provenance, final_score_coalesce, rerank_identity, rerank_scored_topn)}
SQL = {
    "hybrid_search": f"{ALL} SELECT f.request_id, CAST(position AS INTEGER) AS position, f.chunk_id, c.doc_id, d.title AS document_title, d.source_uri, c.section_path, f.rrf_score FROM fus f JOIN chunks c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id WHERE position <= 6",
    "hybrid_filtered": f"WITH {REQUESTS}, {_kw(_WITHIN)}, {_vec(_WITHIN)}, {_FUSED} SELECT request_id, chunk_id, CAST(position AS INTEGER) AS position, rrf_score FROM fus WHERE position <= 6",
    "keyword_rank_topk": f"WITH {REQUESTS}, {_kw()} SELECT request_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM kw",
    "keyword_match_or": f"WITH {REQUESTS}, l AS (SELECT DISTINCT chunk_id, access_group_ids, unnest({LEX("concat_ws(' ', section_path, content)")}) AS lexeme FROM chunks), q AS (SELECT DISTINCT request_id, group_ids, unnest({LEX('question')}) AS lexeme FROM req) SELECT request_id, count(DISTINCT chunk_id) AS n_chunks FROM q JOIN l USING (lexeme) WHERE list_has_any(l.access_group_ids, q.group_ids) GROUP BY 1",
    "keyword_negation_and": _boolean("list_contains(a, 'purchase') AND list_contains(a, 'order') AND NOT list_contains(a, 'invoice')", ["purchase", "order"]),
    "keyword_phrase": _boolean("contains(t, ' latency budget ') AND NOT list_contains(a, 'quarterly')", ["latency", "budget"]),
    "vector_topk_exact": f"WITH {REQUESTS}, {_vec(limit=10, acl='true')} SELECT request_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM vec",
    "vector_topk_acl_filtered": f"WITH {REQUESTS}, {_vec()} SELECT request_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM vec",
    "vector_max_similarity_gate": f"{ALL} SELECT r.request_id, coalesce(max(coalesce(vector_score, 0)), 0) AS best, coalesce(max(coalesce(vector_score, 0)), 0) >= 0.6 AS answerable FROM req r LEFT JOIN fus f ON f.request_id = r.request_id GROUP BY 1",
    "rrf_fuse": f"{ALL} SELECT request_id, chunk_id, CAST(position AS INTEGER) AS position, rrf_score FROM fus",
    "rrf_provenance": f"{ALL} SELECT request_id, chunk_id, concat_ws('+', CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END, CASE WHEN vector_rank IS NOT NULL THEN 'vector' END) AS retrieved_by, CAST(keyword_rank AS INTEGER) AS keyword_rank, CAST(vector_rank AS INTEGER) AS vector_rank FROM fus",
    "final_score_coalesce": f"{ALL} SELECT request_id, chunk_id, rrf_score AS final_score FROM fus",
    "rerank_identity": f"{ALL} SELECT request_id, chunk_id, CAST(position AS INTEGER) AS position FROM fus WHERE position <= 6",
    "rerank_scored_topn": f"{ALL}, s AS (SELECT f.request_id, f.chunk_id, list_distinct({LEX('r.question')}) AS q, list_distinct({LEX('c.content')}) AS c FROM fus f JOIN req r ON r.request_id = f.request_id JOIN chunks c ON c.chunk_id = f.chunk_id), x AS (SELECT request_id, chunk_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, c)) / len(q), 6) ELSE 0.0 END AS rerank_score FROM s) SELECT request_id, chunk_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rerank_score DESC, chunk_id) AS INTEGER) AS position, rerank_score FROM x QUALIFY position <= 6",
}

"""The whole answer flow over the held-out questions, with a deterministic stand-in for the model, and stemmed search."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import stem
from passagework.operators import answers as an
from passagework.operators import embedding as em
from passagework.operators import retrieval as rt
from passagework.plans.retrieval_queries import ALL, USABLE, _fused, chunks, requests
from passagework.plans.text_queries import _CLAIMS, _UNC
from passagework.workspace import table


def _passages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("title").alias("document_title"), "source_uri")
    return chunks(spark, d).select("chunk_id", "doc_id", "content", "section_path", "source_updated_at").join(docs, "doc_id", "left")


def answer_flow(spark, d):
    """Gate, context, model, citations, grounding and confidence of every held-out question."""
    out = an.answer_requests(requests(spark, d).select("request_id", "question"), _fused(spark, d), _passages(spark, d), an.FirstPassageModel, budget=800)
    return out.select("request_id", "status", "reason", F.md5("answer").alias("answer_hash"), F.array_join("cited_doc_ids", ",").alias("cited"), "n_uncited", "grounding", "confidence")


def answer_status_counts(spark, d):
    return answer_flow(spark, d).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def keyword_stemmed_topk(spark, d):
    """Keyword search on stems."""
    c = chunks(spark, d).select("chunk_id", "access_group_ids", stem.stemmed(F.col("section_path")).alias("section_path"), stem.stemmed(F.col("content")).alias("content"))
    r = requests(spark, d).withColumn("question", stem.stemmed(F.col("question")))
    return rt.keyword_topk(c, r).select("request_id", "chunk_id", "rank", "score")


def stale_embeddings(spark, d):
    """Chunks that have no usable vector of the model in use."""
    return em.stale(chunks(spark, d), "nw-embed-2", 64).groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (answer_flow, answer_status_counts, keyword_stemmed_topk, stale_embeddings)}
#: The stand-in answers with the first sentence of the first passage, which no budget drops; passages hold no markers.
_LINES = "list_filter(string_split(content, chr(10)), lambda x: x <> '' AND NOT regexp_matches(x, '^(title: |section: |source: |updated: |#)'))"
_TIDY = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, ' +([.,;:])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
_FLOW = f"""{ALL},
best AS (SELECT r.request_id, coalesce(max(vector_score), 0) AS best, max(CASE WHEN f.position = 1 THEN f.chunk_id END) AS chunk_id FROM req r LEFT JOIN fus f USING (request_id) GROUP BY 1),
said AS (SELECT b.request_id, b.best, c.chunk_id, c.doc_id, rtrim(string_split(coalesce({_LINES}[1], ''), '. ')[1], '.') AS first FROM best b LEFT JOIN chunks c ON c.chunk_id = b.chunk_id AND b.best >= 0.6),
why AS (SELECT *, CASE WHEN best < 0.6 THEN 'no_relevant_candidates' WHEN chunk_id IS NULL THEN 'empty_context' WHEN first = '' THEN 'model_abstained' END AS reason FROM said),
ans AS (SELECT request_id AS outcome_id, {_TIDY("trim(first || ' [1].')")} AS answer, [chunk_id] AS cited_doc_ids FROM why WHERE reason IS NULL),
passages AS (SELECT chunk_id AS doc_id, content AS text FROM chunks), {_CLAIMS.replace("FROM documents", "FROM passages")},
told AS (SELECT outcome_id, answer, {_UNC} AS n_uncited FROM ans)
"""
SQL = {
    "answer_flow": f"{_FLOW} SELECT w.request_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'insufficient_evidence' END AS status, reason, md5(t.answer) AS answer_hash, CASE WHEN reason IS NULL THEN CAST(w.doc_id AS VARCHAR) END AS cited, n_uncited, grounding, CASE WHEN reason IS NULL THEN CASE WHEN grounding >= 0.9 AND n_uncited = 0 THEN 'HIGH' WHEN grounding >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END END AS confidence FROM why w LEFT JOIN told t ON t.outcome_id = w.request_id LEFT JOIN grd g ON g.outcome_id = w.request_id",
    "answer_status_counts": f"{_FLOW} SELECT CASE WHEN reason IS NULL THEN 'answered' ELSE 'insufficient_evidence' END AS status, reason, count(*) AS n FROM why GROUP BY 1, 2",
    "stale_embeddings": f"SELECT embedding_model, count(*) AS n FROM chunks WHERE NOT coalesce(embedding_model = 'nw-embed-2' AND len(embedding) = 64 AND {USABLE('embedding')}, false) GROUP BY 1",
}

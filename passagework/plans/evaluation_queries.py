"""Retrieval quality of the search queries over the held-out cases, and summaries of logged answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import evaluation as ev
from passagework.operators import retrieval as rt
from passagework.plans.access_queries import _ANS, answers
from passagework.plans.retrieval_queries import ALL, _fused, chunks, current, requests
from passagework.workspace import table


def cases(spark, d):
    return table(spark, d, "eval_cases").withColumnRenamed("case_id", "request_id")


def _uris(spark, d, hits):
    where = chunks(spark, d).select("chunk_id", "doc_id").join(table(spark, d, "documents").select("doc_id", "source_uri"), "doc_id")
    return hits.join(where, "chunk_id").select("request_id", "position", "source_uri")


def ranking(spark, d):
    return ev.document_ranking(_uris(spark, d, _fused(spark, d)))


def eval_recall_precision_at_k(spark, d):
    return ev.case_metrics(cases(spark, d), ranking(spark, d)).select("request_id", "k", "recall", "precision")


def eval_ndcg(spark, d):
    return ev.case_metrics(cases(spark, d), ranking(spark, d)).select("request_id", "k", "ndcg")


def eval_mrr(spark, d):
    return ev.case_metrics(cases(spark, d), ranking(spark, d), (1,)).select("request_id", "rr")


def eval_retrieval_summary(spark, d):
    return ev.retrieval_summary(cases(spark, d), ranking(spark, d))


def eval_security(spark, d):
    found = ev.leaks(cases(spark, d), ranking(spark, d))
    checked = cases(spark, d).where(F.size("forbidden_sources") > 0)
    n = checked.agg(F.count(F.lit(1)).alias("n_checked"))
    l = found.agg(F.count(F.lit(1)).alias("n_leaks"))
    return n.withColumn("k", F.lit(1)).join(l.withColumn("k", F.lit(1)), "k").select("n_checked", "n_leaks", (F.col("n_leaks") == 0).alias("passed"))


def eval_abstention(spark, d):
    """Per category: cases, those the gate declines, those where that is what the case asks for."""
    best = _fused(spark, d).groupBy("request_id").agg(F.max(F.coalesce("vector_score", F.lit(0.0))).alias("best"))
    c = cases(spark, d).join(best, "request_id", "left").withColumn("declined", F.coalesce("best", F.lit(0.0)) < 0.60)
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("declined").alias("n_declined"), F.count_if(F.col("declined") == F.col("must_abstain")).alias("n_right"))


def eval_category_counts(spark, d):
    """All categories, those without a case too."""
    spark_cats = spark.createDataFrame([(c,) for c in ev.CATEGORIES], "category string")
    return spark_cats.join(cases(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").na.fill(0, ["n"])


def _top_passages(spark, d):
    """request_id, text, uris of the first three fused passages."""
    top = _fused(spark, d).where("position <= 3").join(chunks(spark, d).select("chunk_id", "content", "doc_id"), "chunk_id").join(table(spark, d, "documents").select("doc_id", "source_uri"), "doc_id", "left")
    s = F.array_sort(F.collect_list(F.struct("position", "content", "source_uri")))
    return top.groupBy("request_id").agg(s.alias("s")).select("request_id", F.array_join(F.transform("s", lambda x: x["content"]), "\n").alias("text"), F.transform("s", lambda x: x["source_uri"]).alias("uris"))


def eval_fact_coverage(spark, d):
    """How many of a case's facts stand in its first three passages."""
    c = cases(spark, d).join(_top_passages(spark, d), "request_id", "left")
    return c.select("request_id", F.round(ev.fact_coverage(F.coalesce("text", F.lit("")), F.col("expected_facts")), 4).alias("coverage"))


def eval_citation_precision(spark, d):
    c = cases(spark, d).join(_top_passages(spark, d), "request_id", "left")
    empty = F.array().cast("array<string>")
    return c.select("request_id", F.round(ev.citation_precision(F.coalesce("uris", empty), F.coalesce("expected_sources", empty)), 4).alias("citation_precision"))


def eval_percentiles(spark, d):
    """Latencies of logged answers, zeros and nulls left out."""
    o = answers(spark, d).where("latency_ms > 0")
    return o.groupBy("status").agg(ev.nearest_rank("latency_ms", 0.5).cast("int").alias("p50"), ev.nearest_rank("latency_ms", 0.95).cast("int").alias("p95"), F.max("latency_ms").alias("longest"), F.count(F.lit(1)).alias("n"))


def eval_generation(spark, d):
    o = answers(spark, d).where("status = 'answered'")
    return o.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("grounding_score"), 4).alias("mean_grounding"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("estimated_cost_usd").cast("decimal(18,6)").alias("cost"))


def eval_compare_runs(spark, d):
    """Keyword search alone against the fused ranking."""
    asked, c = requests(spark, d), cases(spark, d)

    def run(hits):
        r = ev.document_ranking(_uris(spark, d, hits))
        order = r.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_uri"))), lambda s: s["source_uri"]), "|").alias("ranking"))
        return ev.case_metrics(c, r, (1,)).select("request_id", "rr").join(order, "request_id")

    keyword = rt.keyword_topk(chunks(spark, d), asked)
    fused = rt.fuse(keyword, rt.vector_topk(current(chunks(spark, d)), asked))
    return ev.compare_runs(run(keyword.withColumn("position", F.col("rank")).where("rank <= 30")), run(fused))


def eval_failures(spark, d):
    """Cases with the reasons why they fail."""
    r = ranking(spark, d)
    m = ev.case_metrics(cases(spark, d), r, (10,)).select("request_id", "recall")
    bad = ev.leaks(cases(spark, d), r).select("request_id", F.lit(True).alias("leaked"))
    c = cases(spark, d).join(m, "request_id").join(bad, "request_id", "left")
    why = F.array_compact(F.array(F.when((F.size("expected_sources") > 0) & (F.col("recall") == 0), "nothing expected was found"), F.when(F.col("leaked"), "a forbidden source was found")))
    return c.select("request_id", F.array_join(why, "; ").alias("reasons")).where("reasons <> ''")


_RANK = """
pos0 AS (SELECT f.request_id, d.source_uri, min(f.position) AS p FROM fus f JOIN chunks c USING (chunk_id) JOIN documents d USING (doc_id) GROUP BY 1, 2),
ran AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p, source_uri) AS rank FROM pos0 QUALIFY rank <= 10),
cas AS (SELECT case_id AS request_id, category, list_distinct(expected_sources) AS rel, expected_sources, forbidden_sources, must_abstain, expected_facts FROM eval_cases),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
hit AS (SELECT c.request_id, r.rank FROM cas c JOIN ran r ON r.request_id = c.request_id AND list_contains(c.rel, r.source_uri)),
met AS (SELECT c.request_id, k, CASE WHEN len(any_value(rel)) > 0 THEN count(h.rank) / len(any_value(rel)) ELSE 0 END AS recall, count(h.rank) / k AS precision,
  CASE WHEN len(any_value(rel)) > 0 THEN coalesce(sum(1 / log2(h.rank + 1)), 0) / list_sum(list_transform(range(1, least(k, len(any_value(rel))) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg
  FROM cas c CROSS JOIN ks LEFT JOIN hit h ON h.request_id = c.request_id AND h.rank <= k GROUP BY 1, 2),
rrs AS (SELECT c.request_id, coalesce(1 / min(h.rank), 0) AS rr FROM cas c LEFT JOIN hit h USING (request_id) GROUP BY 1)"""
_MEAN = lambda c: f"floor(CAST(sum(CAST(round(round({c}, 4) * 10000) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 10000"
_E = f"{ALL}, {_RANK}"
_TOP3 = "top3 AS (SELECT f.request_id, string_agg(content, chr(10) ORDER BY position) AS text, list(source_uri) AS uris FROM fus f JOIN chunks c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id WHERE position <= 3 GROUP BY 1)"
_PLAIN = lambda c: f"lower(trim(regexp_replace({c}, '[\\s\\v]+', ' ', 'g')))"

QUERIES = {f.__name__: f for f in (eval_recall_precision_at_k, eval_ndcg, eval_mrr, eval_retrieval_summary, eval_security, eval_abstention, eval_category_counts, eval_fact_coverage, eval_citation_precision, eval_percentiles, eval_generation, eval_compare_runs, eval_failures)}
SQL = {
    "eval_recall_precision_at_k": f"{_E} SELECT request_id, CAST(k AS INTEGER) AS k, round(recall, 4) AS recall, round(precision, 4) AS precision FROM met",
    "eval_ndcg": f"{_E} SELECT request_id, CAST(k AS INTEGER) AS k, round(ndcg, 4) AS ndcg FROM met",
    "eval_mrr": f"{_E} SELECT request_id, round(rr, 4) AS rr FROM rrs",
    "eval_retrieval_summary": f"{_E} SELECT CAST(k AS INTEGER) AS k, {_MEAN('recall')} AS recall, {_MEAN('precision')} AS precision, {_MEAN('ndcg')} AS ndcg, {_MEAN('rr')} AS mrr, count(*) AS n_cases FROM met JOIN rrs USING (request_id) JOIN cas USING (request_id) WHERE len(expected_sources) > 0 GROUP BY 1",
    "eval_security": f"{_E}, l AS (SELECT DISTINCT c.request_id FROM cas c JOIN ran r ON r.request_id = c.request_id AND list_contains(c.forbidden_sources, r.source_uri)) SELECT (SELECT count(*) FROM cas WHERE len(forbidden_sources) > 0) AS n_checked, count(*) AS n_leaks, count(*) = 0 AS passed FROM l",
    "eval_abstention": f"{_E}, b AS (SELECT c.request_id, c.category, c.must_abstain, coalesce(max(coalesce(vector_score, 0)), 0) < 0.6 AS declined FROM cas c LEFT JOIN fus f USING (request_id) GROUP BY 1, 2, 3) SELECT category, count(*) AS n, count(*) FILTER (declined) AS n_declined, count(*) FILTER (declined = must_abstain) AS n_right FROM b GROUP BY 1",
    "eval_category_counts": "SELECT c AS category, count(case_id) AS n FROM (SELECT unnest(['factoid', 'multi_hop', 'permission_negative', 'unanswerable']) AS c) LEFT JOIN eval_cases ON category = c GROUP BY 1",
    "eval_fact_coverage": f"{_E}, {_TOP3} SELECT c.request_id, round(CASE WHEN len(expected_facts) > 0 THEN len(list_filter(expected_facts, lambda f: len(list_filter(string_split(f, '|'), lambda a: {_PLAIN('a')} <> '' AND contains({_PLAIN("coalesce(t.text, '')")}, {_PLAIN('a')}))) > 0)) / len(expected_facts) ELSE 1.0 END, 4) AS coverage FROM cas c LEFT JOIN top3 t USING (request_id)",
    "eval_citation_precision": f"{_E}, {_TOP3} SELECT c.request_id, round(CASE WHEN len(list_distinct(uris)) > 0 THEN len(list_intersect(list_distinct(uris), rel)) / len(list_distinct(uris)) ELSE 0.0 END, 4) AS citation_precision FROM cas c LEFT JOIN top3 t USING (request_id)",
    "eval_percentiles": f"WITH {_ANS} SELECT status, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS longest, count(*) AS n FROM ans WHERE latency_ms > 0 GROUP BY 1",
    "eval_generation": f"WITH {_ANS} SELECT confidence, count(*) AS n, round(avg(grounding_score), 4) AS mean_grounding, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(estimated_cost_usd) AS DECIMAL(18,6)) AS cost FROM ans WHERE status = 'answered' GROUP BY 1",
    "eval_compare_runs": f"""{_E},
kp AS (SELECT k.request_id, d.source_uri, min(k.rank) AS p FROM kw k JOIN chunks c USING (chunk_id) JOIN documents d USING (doc_id) WHERE k.rank <= 30 GROUP BY 1, 2),
kr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p, source_uri) AS rank FROM kp QUALIFY rank <= 10),
kx AS (SELECT c.request_id, coalesce(round(1 / min(CASE WHEN list_contains(c.rel, r.source_uri) THEN r.rank END), 4), 0) AS rr, string_agg(r.source_uri, '|' ORDER BY r.rank) AS ranking FROM cas c JOIN kr r USING (request_id) GROUP BY 1),
fx AS (SELECT c.request_id, coalesce(round(1 / min(CASE WHEN list_contains(c.rel, r.source_uri) THEN r.rank END), 4), 0) AS rr, string_agg(r.source_uri, '|' ORDER BY r.rank) AS ranking FROM cas c JOIN ran r USING (request_id) GROUP BY 1)
SELECT count(*) AS n_shared, count(*) FILTER (kx.ranking <> fx.ranking) AS n_reordered, count(*) FILTER (fx.rr - kx.rr >= 5e-4) AS n_improved, count(*) FILTER (fx.rr - kx.rr <= -5e-4) AS n_regressed FROM kx JOIN fx USING (request_id)""",
    "eval_failures": f"{_E}, l AS (SELECT DISTINCT c.request_id FROM cas c JOIN ran r ON r.request_id = c.request_id AND list_contains(c.forbidden_sources, r.source_uri)), x AS (SELECT c.request_id, concat_ws('; ', CASE WHEN len(expected_sources) > 0 AND m.recall = 0 THEN 'nothing expected was found' END, CASE WHEN l.request_id IS NOT NULL THEN 'a forbidden source was found' END) AS reasons FROM cas c JOIN met m ON m.request_id = c.request_id AND k = 10 LEFT JOIN l ON l.request_id = c.request_id) SELECT * FROM x WHERE reasons <> ''",
}

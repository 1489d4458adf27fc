"""Scalar text functions, citations, grounding, confidence and context over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.operators import answers as an
from passagework.operators import retrieval as rt
from passagework.plans.access_queries import _ANS, answers
from passagework.plans.retrieval_queries import ALL, _fused
from passagework.workspace import table


def token_count(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", tx.token_count(F.col("content")).alias("n_tokens"), F.col("token_count").alias("stored"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


def duplicate_documents(spark, d):
    """Documents whose text is the same but for blanks: the group's least id and its size."""
    h = table(spark, d, "documents").where("text is not null").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_doc_id", "n")


def embed_text_prefix(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", F.md5(tx.embed_text(F.col("section_path"), F.col("content"))).alias("embed_hash"))


def title_from_path(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.title_from_path(F.col("source_uri")).alias("title_guess"), tx.source_type(F.col("source_uri")).alias("type_guess"))


def snippets(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.md5(tx.snippet(F.col("content"))).alias("snippet_hash"))


def render_passage(spark, d):
    c = table(spark, d, "chunks").join(table(spark, d, "documents").select("doc_id", "title", "source_uri"), "doc_id", "left")
    return c.select("chunk_id", F.md5(tx.render_passage(F.col("chunk_index") + 1, F.col("title"), F.col("section_path"), F.col("source_uri"), F.col("source_updated_at"), F.col("content"))).alias("passage_hash"))


def render_blocks(spark, d):
    b = table(spark, d, "blocks")
    return b.select("doc_id", "block_pos", F.md5(tx.render_block(F.col("block_type"), F.col("block_text"), F.col("block_level"), F.col("code_lang"))).alias("block_hash"))


def client_address(spark, d):
    """Forwarding headers put together from the log: request, user and document stand for three hops."""
    e = table(spark, d, "access_events").select("access_id", F.concat_ws(", ", "request_id", F.col("user_id").cast("string")).alias("forwarded"), F.col("doc_id").cast("string").alias("peer")).distinct()
    return e.select("access_id", tx.client_address(F.col("forwarded"), F.col("peer"), 2).alias("address")).distinct()


def citation_extract(spark, d):
    a = answers(spark, d).where("answer is not null")
    return a.select("outcome_id", F.array_join(tx.citation_numbers(F.col("answer")).cast("array<string>"), ",").alias("numbers"))


def citation_invalid(spark, d):
    """Markers beyond the cited documents, and the number of sentences of six words or more without any marker."""
    a = an.with_citations(answers(spark, d))
    return a.select("outcome_id", F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"))


def uncited_sentences(spark, d):
    """Counted once invalid markers are gone: a sentence with a made-up marker alone cites nothing."""
    a = an.renumbered(answers(spark, d))
    return a.select("outcome_id", an.uncited_count(F.col("clean_answer")).alias("n_uncited"))


def citation_resolve(spark, d):
    """Valid numbers in order of first appearance with the document each stands for."""
    a = an.with_citations(answers(spark, d))
    each = a.select("outcome_id", F.posexplode("ordered").alias("i", "number"), "cited_doc_ids")
    return each.select("outcome_id", (F.col("i") + 1).alias("new_number"), "number", F.element_at("cited_doc_ids", F.col("number")).alias("doc_id"))


def citation_texts(spark, d):
    """Answers with markers renumbered and invalid ones gone."""
    return an.renumbered(answers(spark, d).where("answer is not null")).select("outcome_id", "clean_answer")


def lexical_support(spark, d):
    """Every claim of an answer against each document it could rest on."""
    s = an.claim_support(answers(spark, d), table(spark, d, "documents"))
    return s.select("outcome_id", "claim_no", "n_targets", F.round("support", 3).alias("support"))


def grounding_report(spark, d):
    g = an.grounding(an.claim_support(answers(spark, d), table(spark, d, "documents")), answers(spark, d))
    return g.select("outcome_id", "n_claims", "n_supported", "grounding", "passed")


def confidence_band(spark, d):
    g = an.grounding(an.claim_support(answers(spark, d), table(spark, d, "documents")), answers(spark, d))
    a = an.renumbered(answers(spark, d)).select("outcome_id", "request_id", F.size("ordered").alias("n_citations"), an.uncited_count(F.col("clean_answer")).alias("n_uncited"))
    # the log keeps no scores, but each retrieved document it names had a fused score of at least that of the last rank
    least = 1.0 / (rt.RRF_K + rt.RETRIEVER_LIMIT)
    top = table(spark, d, "access_events").where("doc_id is not null").groupBy("request_id").agg(F.lit(least).alias("top"))
    full = g.join(a, "outcome_id").join(top, "request_id", "left")
    return full.select("outcome_id", an.band(F.col("grounding"), F.col("n_uncited"), F.col("n_citations"), F.coalesce("top", F.lit(0.0))).alias("band"))


SENTINEL = "I could not find enough evidence in the documents you may read to answer this."


def abstention_sentinel(spark, d):
    a = answers(spark, d).where("answer is not null")
    return a.groupBy("status", tx.is_abstention(F.col("answer"), SENTINEL).alias("is_sentinel")).agg(F.count(F.lit(1)).alias("n"))


def context_budget_dedup(spark, d):
    """The passages of each question's context: in rank order, near-copies dropped, until the token budget is full."""
    shown = table(spark, d, "chunks").select("chunk_id", "doc_id", "content", "section_path", "source_updated_at").join(table(spark, d, "documents").select("doc_id", F.col("title").alias("document_title"), "source_uri"), "doc_id", "left")
    fused = _fused(spark, d).join(shown, "chunk_id")
    return an.build_context(fused, 800).select("request_id", "chunk_id", "number", "tokens", "running")


def score_margin(spark, d):
    """First less fourth fused score; a fourth that is not there counts as 0."""
    f = _fused(spark, d)
    scores = f.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "rrf_score"))).alias("s"))
    return scores.select("request_id", F.round(F.element_at("s", 1)["rrf_score"] - F.coalesce(F.try_element_at("s", F.lit(4))["rrf_score"], F.lit(0.0)), 9).alias("margin"))


_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COLL = lambda c: f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"
_TOK = lambda c: f"(CASE WHEN {c} IS NULL OR length({_COLL(c)}) = 0 THEN 0 ELSE greatest(1, round(length({_COLL(c)}) / CAST(3.8 AS DOUBLE))) END)"
_NUMS = "list_transform(regexp_extract_all(answer, '\\[(\\d{1,3})\\]', 1), lambda x: CAST(x AS INTEGER))"
_SENT = "list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_NWORDS = lambda c: f"len(list_filter(string_split(regexp_replace({c}, '{_WS}+', ' ', 'g'), ' '), lambda w: w <> ''))"
_CIT = f"cit AS (SELECT *, {_NUMS} AS nums FROM ans), cv AS (SELECT *, list_filter(nums, lambda n: n >= 1 AND n <= len(cited_doc_ids)) AS valid FROM cit)"
_ORDER = f"{_CIT}, co AS (SELECT *, list_filter(valid, lambda x, i: list_position(valid, x) = i) AS ordered, regexp_split_to_array(answer, '\\[\\d{{1,3}}\\]') AS parts FROM cv WHERE answer IS NOT NULL)"
_JOINED = "array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i <= len(nums) AND list_contains(ordered, nums[i]) THEN '[' || list_position(ordered, nums[i]) || ']' ELSE '' END), '')"
_CLEANED = f"{_ORDER}, cl AS (SELECT * EXCLUDE (answer), regexp_replace(regexp_replace(regexp_replace({_JOINED}, ' +([.,;:])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS answer FROM co)"
_STOPW = "[" + ", ".join(f"'{w}'" for w in tx.CLAIM_STOP_WORDS) + "]"
_CW = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z0-9$%.:/-]+'), lambda w: regexp_replace(w, '^[.,:;/-]+|[.,:;/-]+$', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains({_STOPW}, w)))"
_CLAIMS = f"""
sen AS (SELECT outcome_id, cited_doc_ids, i - 1 AS claim_no, s[i] AS claim FROM (SELECT outcome_id, cited_doc_ids, {_SENT} AS s, unnest(range(1, len({_SENT}) + 1)) AS i FROM ans WHERE answer IS NOT NULL)),
clm AS (SELECT *, list_filter(list_distinct(list_transform(regexp_extract_all(claim, '\\[(\\d{{1,3}})\\]', 1), lambda x: CAST(x AS INTEGER))), lambda n: n >= 1 AND n <= len(cited_doc_ids)) AS own FROM sen WHERE {_NWORDS("claim")} >= 6),
tgt AS (SELECT outcome_id, claim_no, claim, unnest(CASE WHEN len(own) > 0 THEN list_transform(own, lambda n: cited_doc_ids[n]) ELSE list_distinct(cited_doc_ids) END) AS doc_id FROM clm),
cw AS (SELECT outcome_id, claim_no, {_CW("regexp_replace(claim, '\\[\\d{1,3}\\]', '', 'g')")} AS w FROM clm),
dw AS (SELECT doc_id, {_CW("text")} AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM tgt)),
sup AS (SELECT c.outcome_id, c.claim_no, count(d.doc_id) AS n_targets, coalesce(max(CASE WHEN len(c.w) > 0 THEN len(list_intersect(c.w, d.w)) / len(c.w) ELSE 0 END), 0) AS support FROM cw c LEFT JOIN (SELECT DISTINCT outcome_id, claim_no, doc_id FROM tgt) t USING (outcome_id, claim_no) LEFT JOIN dw d ON d.doc_id = t.doc_id GROUP BY 1, 2),
gr AS (SELECT a.outcome_id, count(s.claim_no) AS n_claims, count(s.claim_no) FILTER (support >= 0.45) AS n_supported FROM ans a LEFT JOIN sup s USING (outcome_id) WHERE a.answer IS NOT NULL GROUP BY 1),
grd AS (SELECT *, CASE WHEN n_claims = 0 THEN 1.0 ELSE round(n_supported / n_claims, 3) END AS grounding FROM gr)"""
_UNC = f"CAST(len(list_filter({_SENT}, lambda s: NOT regexp_matches(s, '\\[\\d{{1,3}}\\]') AND {_NWORDS('s')} >= 6)) AS INTEGER)"
_COST = "greatest(1, floor((c.l + length(CAST(g.number + 1 AS VARCHAR))) / CAST(3.8 AS DOUBLE) + 0.5))"
_PARTS = "string_split(section_path, ' > ')"

QUERIES = {f.__name__: f for f in (token_count, content_hash, duplicate_documents, embed_text_prefix, title_from_path, snippets, render_passage, render_blocks, client_address, citation_extract, citation_invalid, uncited_sentences, citation_resolve, citation_texts, lexical_support, grounding_report, confidence_band, abstention_sentinel, context_budget_dedup, score_margin)}
SQL = {
    "token_count": f"SELECT chunk_id, CAST({_TOK('content')} AS INTEGER) AS n_tokens, token_count AS stored FROM chunks",
    "content_hash": f"SELECT doc_id, sha256({_COLL('text')}) AS hash FROM documents",
    "duplicate_documents": f"SELECT min(doc_id) AS first_doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256({_COLL('text')}) HAVING n > 1",
    "embed_text_prefix": f"WITH x AS (SELECT chunk_id, content, section_path, CASE WHEN trim(regexp_replace(string_split(content, chr(10))[1], '^#+[ ]*', '')) = {_PARTS}[-1] THEN array_to_string({_PARTS}[1:len({_PARTS}) - 1], ' > ') ELSE section_path END AS kept FROM chunks) SELECT chunk_id, md5(CASE WHEN kept IS NULL OR kept = '' THEN content ELSE concat_ws(chr(10) || chr(10), kept, content) END) AS embed_hash FROM x",
    "title_from_path": r"""
WITH p AS (SELECT doc_id, source_uri, string_split(source_uri, '/') AS p FROM documents), n AS (SELECT *, regexp_replace(p[-1], '\.[^.]*$', '') AS n FROM p),
s AS (SELECT *, trim(regexp_replace(CASE WHEN lower(n) = 'readme' AND len(p) > 1 THEN p[-2] ELSE n END, '[-_ ]+', ' ', 'g')) AS s FROM n)
SELECT doc_id, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title_guess,
  CASE WHEN regexp_matches(lower(source_uri), '\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(lower(source_uri), '\.(txt|text)$') THEN 'txt' WHEN lower(source_uri) LIKE '%.pdf' THEN 'pdf' WHEN lower(source_uri) LIKE '%.docx' THEN 'docx' END AS type_guess FROM s""",
    "snippets": "SELECT chunk_id, md5(CASE WHEN length(content) <= 420 THEN content ELSE regexp_replace(substr(content, 1, 420), ' [^ ]*$', '') || ' …' END) AS snippet_hash FROM chunks",
    "render_passage": "SELECT chunk_id, md5(concat_ws(chr(10), '[passage ' || (chunk_index + 1) || ']', 'title: ' || title, 'section: ' || section_path, 'source: ' || source_uri, 'updated: ' || strftime(c.source_updated_at, '%Y-%m-%d'), content, '[end]')) AS passage_hash FROM chunks c LEFT JOIN documents d USING (doc_id)",
    "render_blocks": "SELECT doc_id, block_pos, md5(CASE block_type WHEN 'code' THEN '```' || coalesce(code_lang, '') || chr(10) || block_text || chr(10) || '```' WHEN 'heading' THEN repeat('#', coalesce(block_level, 1)) || ' ' || block_text ELSE block_text END) AS block_hash FROM blocks",
    "client_address": "SELECT DISTINCT access_id, CASE WHEN user_id IS NOT NULL AND request_id IS NOT NULL THEN request_id ELSE CAST(doc_id AS VARCHAR) END AS address FROM access_events",
    "citation_extract": f"WITH {_ANS} SELECT outcome_id, array_to_string({_NUMS}, ',') AS numbers FROM ans WHERE answer IS NOT NULL",
    "citation_invalid": f"WITH {_ANS}, {_CIT} SELECT outcome_id, array_to_string(list_sort(list_distinct(list_filter(nums, lambda n: n < 1 OR n > len(cited_doc_ids)))), ',') AS invalid FROM cv WHERE answer IS NOT NULL",
    "uncited_sentences": f"WITH {_ANS}, {_CLEANED} SELECT outcome_id, {_UNC} AS n_uncited FROM cl",
    "citation_texts": f"WITH {_ANS}, {_CLEANED} SELECT outcome_id, answer AS clean_answer FROM cl",
    "citation_resolve": f"WITH {_ANS}, {_CIT}, e AS (SELECT outcome_id, cited_doc_ids, valid[i] AS number, i FROM (SELECT *, unnest(range(1, len(valid) + 1)) AS i FROM cv)), f AS (SELECT outcome_id, number, min(i) AS i, any_value(cited_doc_ids) AS c FROM e GROUP BY 1, 2) SELECT outcome_id, CAST(row_number() OVER (PARTITION BY outcome_id ORDER BY i) AS INTEGER) AS new_number, number, c[number] AS doc_id FROM f",
    "lexical_support": f"WITH {_ANS}, {_CLAIMS} SELECT outcome_id, CAST(claim_no AS INTEGER) AS claim_no, n_targets, round(support, 3) AS support FROM sup",
    "grounding_report": f"WITH {_ANS}, {_CLAIMS} SELECT outcome_id, n_claims, n_supported, grounding, grounding >= 0.70 AS passed FROM grd",
    "confidence_band": f"WITH {_ANS}, {_CLEANED}, {_CLAIMS}, x AS (SELECT outcome_id, len(ordered) AS nc, {_UNC} AS un, request_id IN (SELECT request_id FROM access_events WHERE doc_id IS NOT NULL) AS found FROM cl) SELECT outcome_id, CASE WHEN nc = 0 THEN 'LOW' WHEN grounding >= 0.9 AND un = 0 AND found THEN 'HIGH' WHEN grounding >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM grd JOIN x USING (outcome_id)",
    "abstention_sentinel": f"WITH {_ANS} SELECT status, trim(regexp_replace(trim(answer), '^\\.+|\\.+$', '', 'g')) = '{SENTINEL.strip('.')}' OR (contains(answer, '{SENTINEL.strip('.')}') AND length(answer) < {len(SENTINEL) + 80}) AS is_sentinel, count(*) AS n FROM ans WHERE answer IS NOT NULL GROUP BY 1, 2",
    "context_budget_dedup": f"""
WITH RECURSIVE {ALL[5:]},
r AS (SELECT chunk_id, content, length({_COLL("concat_ws(chr(10), '[passage ]', 'title: ' || title, 'section: ' || section_path, 'source: ' || source_uri, 'updated: ' || strftime(k.source_updated_at, '%Y-%m-%d'), content, '[end]')")}) AS l FROM chunks k LEFT JOIN documents d USING (doc_id)),
c AS (SELECT f.request_id, f.position, f.chunk_id, c.l, list_distinct(list_filter(string_split(lower({_COLL('c.content')}), ' '), lambda w: length(w) > 3)) AS w FROM fus f JOIN r c USING (chunk_id)),
g AS (
  SELECT request_id, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS chunk_id, false AS took, 0 AS number, CAST(0 AS DOUBLE) AS tokens, CAST(0 AS DOUBLE) AS running, CAST([] AS VARCHAR[][]) AS kept, false AS full_up FROM (SELECT DISTINCT request_id FROM c)
  UNION ALL
  SELECT request_id, position, chunk_id, took, number + CAST(took AS INTEGER), t, running + CASE WHEN took THEN t ELSE 0 END, CASE WHEN took THEN list_append(kept, w) ELSE kept END, full_up OR (NOT dup AND NOT took)
  FROM (SELECT g.request_id, c.position, c.chunk_id, {_COST} AS t, c.w, g.number, g.running, g.kept, g.full_up,
      len(list_filter(g.kept, lambda k: least(len(k), len(c.w)) > 0 AND len(list_intersect(k, c.w)) >= 0.85 * least(len(k), len(c.w)))) > 0 AS dup,
      NOT g.full_up AND NOT (len(list_filter(g.kept, lambda k: least(len(k), len(c.w)) > 0 AND len(list_intersect(k, c.w)) >= 0.85 * least(len(k), len(c.w)))) > 0) AND (g.number = 0 OR g.running + {_COST} <= 800) AS took
    FROM g JOIN c ON c.request_id = g.request_id AND c.position = g.position + 1))
SELECT request_id, chunk_id, CAST(number AS INTEGER) AS number, CAST(tokens AS INTEGER) AS tokens, CAST(running AS INTEGER) AS running FROM g WHERE took""",
    "score_margin": f"{ALL} SELECT request_id, round(max(rrf_score) FILTER (position = 1) - coalesce(max(rrf_score) FILTER (position = 4), 0), 9) AS margin FROM fus GROUP BY 1",
}

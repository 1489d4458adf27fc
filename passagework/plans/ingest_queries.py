"""Parsing, chunking and synchronising over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.operators import chunking as ch
from passagework.operators import parsing as pa
from passagework.operators import sync as sy
from passagework.operators.snapshots import canonical_revision, canonical_status, canonical_uri
from passagework.plans.snapshot_queries import _REVISION, _STATUS, _URI
from passagework.workspace import table


def heading_paths(spark, d):
    """Trails from the headings alone."""
    got = pa.heading_paths(table(spark, d, "blocks"))
    return got.select("doc_id", "block_pos", F.array_join("trail", " > ").alias("trail"))


def heading_path_mismatches(spark, d):
    """Blocks whose stored trail is not what the headings above it say."""
    got = pa.heading_paths(table(spark, d, "blocks"))
    return got.where(~(F.array_join("trail", " > ").eqNullSafe(F.array_join("heading_path", " > ")))).groupBy("block_type").agg(F.count(F.lit(1)).alias("n"))


def markdown_blocks(spark, d):
    return pa.parse_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "block_pos", "block_type", "block_text", "block_level", "line_start", "line_end", F.array_join("heading_path", " > ").alias("trail"))


def text_blocks(spark, d):
    """Plain-text paragraphs and capital headings, as islands of lines."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    s = F.trim("line")
    heading = (F.length(s) <= 72) & s.rlike("[A-Z]") & (s == F.upper(s)) & ~s.rlike("[.,;:!?]$") & ~s.rlike(r"^([-*+]|\d{1,9}[.)])[ \t]")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    df = lines.select("doc_id", "line_no", s.alias("s"), (s == "").alias("blank"), heading.alias("heading"))
    starts = ~F.col("blank") & (F.col("heading") | F.coalesce(F.lag("blank").over(w), F.lit(True)) | F.coalesce(F.lag("heading").over(w), F.lit(False)))
    df = df.withColumn("block", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("not blank")
    return df.groupBy("doc_id", "block").agg(F.first("heading").alias("is_heading"), F.count(F.lit(1)).alias("n_lines"), (F.min("line_no") + 1).alias("line_start"))


def chunk_documents(spark, d):
    return ch.chunk_documents(table(spark, d, "documents").select("doc_id", "text")).drop("content")


def chunking_stats(spark, d):
    return ch.chunk_stats(table(spark, d, "chunks"))


def token_histogram(spark, d):
    return ch.token_histogram(table(spark, d, "chunks"))


def corpus_stats(spark, d):
    return sy.corpus_stats(table(spark, d, "chunks"))


def chunks_per_document(spark, d):
    return table(spark, d, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_index").alias("last_index"))


def modal_size(spark, d):
    """The block length class that most characters stand in, per document: the first of equals."""
    b = table(spark, d, "blocks").select("doc_id", "block_pos", F.length("block_text").alias("n"), F.floor(F.length("block_text") / 100).alias("size"))
    per = b.groupBy("doc_id", "size").agg(F.sum("n").alias("chars"), F.min("block_pos").alias("seen"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("seen"))).alias("modal"))


def _states(spark, d):
    """Every record of every listing: snapshot_no, source, source_uri, revision, content_hash."""
    s = table(spark, d, "source_snapshots").where("snapshot_no is not null").select("snapshot_no", "source", canonical_uri(F.col("source_uri")).alias("source_uri"), canonical_revision(F.col("revision")).alias("revision"), "delivered_at", F.coalesce("title", F.lit("")).alias("title"))
    last = s.groupBy("snapshot_no", "source", "source_uri").agg(F.max(F.struct("delivered_at", "revision", "title")).alias("r"))
    return last.select("snapshot_no", "source", "source_uri", F.col("r.revision").alias("revision"), F.sha2("r.title", 256).alias("content_hash"))


def _failed(spark, d):
    return table(spark, d, "sync_outcomes").select(F.col("sync_no").alias("snapshot_no"), "source", canonical_uri(F.col("source_uri")).alias("source_uri"), (canonical_status(F.col("status")) == "failed").alias("f")).groupBy("snapshot_no", "source", "source_uri").agg(F.max("f").alias("failed"))


def sync_steps(spark, d):
    """Every listing of each source held against the source's last listing before it, whatever numbers lie between; the
    title stands for the content."""
    new = _states(spark, d)
    order = table(spark, d, "source_snapshots").where("snapshot_no is not null").select("source", F.col("snapshot_no").alias("before")).distinct()
    order = order.withColumn("snapshot_no", F.lead("before").over(Window.partitionBy("source").orderBy("before"))).where("snapshot_no is not null")
    old = new.withColumnRenamed("snapshot_no", "before").join(order, ["source", "before"]).withColumn("doc_id", F.xxhash64("source", "source_uri")).withColumn("version", F.lit(1))
    listing = new.join(_failed(spark, d), ["snapshot_no", "source", "source_uri"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return sy.sync_plan(old, listing, step=("snapshot_no",)).select("snapshot_no", "source", "source_uri", "status", "version")


def sync_steps_prune(spark, d):
    return sync_steps(spark, d).where("status = 'removed'").select("snapshot_no", "source", "source_uri")


def sync_plan(spark, d):
    """The fourth listing held against the fifth, as its SQL has it: a source without a fourth listing starts anew here.
    sync_steps() goes by each source's own last listing."""
    old, new = (_states(spark, d).where(F.col("snapshot_no") == n).drop("snapshot_no") for n in (4, 5))
    old = old.withColumn("doc_id", F.xxhash64("source", "source_uri")).withColumn("version", F.lit(1))
    failed = _failed(spark, d).where("snapshot_no = 5").drop("snapshot_no")
    new = new.join(failed, ["source", "source_uri"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return sy.sync_plan(old, new).select("source", "source_uri", "status", "version")


def sync_prune(spark, d):
    return sync_plan(spark, d).where("status = 'removed'").select("source", "source_uri")


def sync_report(spark, d):
    return sy.report(table(spark, d, "sync_outcomes"), canonical_status(F.col("status")), "sync_no", "source")


def doc_version_bump(spark, d):
    """How often each document was ingested or updated: its version after the last sync."""
    o = table(spark, d, "sync_outcomes").select("sync_no", "source", canonical_uri(F.col("source_uri")).alias("source_uri"), canonical_status(F.col("status")).alias("status"), "finished_at")
    last = o.groupBy("sync_no", "source", "source_uri").agg(F.max(F.struct("finished_at", "status"))["status"].alias("status"))
    return last.groupBy("source", "source_uri").agg(F.count_if(F.col("status").isin("ingested", "updated")).alias("version"))


_STATE = lambda n, name: f"{name} AS (SELECT source, u AS source_uri, r AS revision, sha256(t) AS content_hash FROM (SELECT source, {_URI} AS u, {_REVISION} AS r, coalesce(title, '') AS t, delivered_at FROM source_snapshots WHERE snapshot_no = {n}) QUALIFY row_number() OVER (PARTITION BY source, u ORDER BY delivered_at DESC, r DESC NULLS LAST, t DESC) = 1)"
_PLAN = f"""
WITH {_STATE(4, 'o')}, {_STATE(5, 'n')},
fl AS (SELECT source, {_URI} AS source_uri, bool_or({_STATUS} = 'failed') AS failed FROM sync_outcomes WHERE sync_no = 5 GROUP BY 1, 2),
p AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.source_uri, n.source_uri) AS source_uri,
  CASE WHEN n.source IS NULL THEN CASE WHEN coalesce(o.source, n.source) IN (SELECT source FROM n) THEN 'removed' END WHEN coalesce(fl.failed, false) THEN 'failed' WHEN o.source IS NULL THEN 'ingested'
    WHEN (n.revision IS NOT NULL AND coalesce(n.revision = o.revision, false)) OR n.content_hash = o.content_hash THEN 'unchanged' ELSE 'updated' END AS status, o.source AS was
  FROM o FULL JOIN n ON o.source = n.source AND o.source_uri = n.source_uri LEFT JOIN fl ON fl.source = n.source AND fl.source_uri = n.source_uri)"""
_STEPS = f"""
WITH l AS (SELECT snapshot_no AS n, source, u, r, sha256(t) AS h FROM (SELECT snapshot_no, source, {_URI} AS u, {_REVISION} AS r, coalesce(title, '') AS t, delivered_at FROM source_snapshots WHERE snapshot_no IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY snapshot_no, source, u ORDER BY delivered_at DESC, r DESC NULLS LAST, t DESC) = 1),
k AS (SELECT source, n, lag(n) OVER (PARTITION BY source ORDER BY n) AS p FROM (SELECT DISTINCT source, n FROM l)),
fl AS (SELECT sync_no AS n, source, {_URI} AS u, bool_or({_STATUS} = 'failed') AS failed FROM sync_outcomes GROUP BY 1, 2, 3),
p AS (
  SELECT l.n, l.source, l.u, CASE WHEN coalesce(fl.failed, false) THEN 'failed' WHEN o.source IS NULL THEN 'ingested' WHEN coalesce(l.r = o.r, false) OR l.h = o.h THEN 'unchanged' ELSE 'updated' END AS status, o.source AS was
  FROM l JOIN k ON k.source = l.source AND k.n = l.n LEFT JOIN l o ON o.source = l.source AND o.u = l.u AND o.n = k.p LEFT JOIN fl ON fl.n = l.n AND fl.source = l.source AND fl.u = l.u
  UNION ALL SELECT k.n, o.source, o.u, 'removed', o.source FROM k JOIN l o ON o.source = k.source AND o.n = k.p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source = o.source AND l.u = o.u AND l.n = k.n))"""

QUERIES = {f.__name__: f for f in (heading_paths, heading_path_mismatches, markdown_blocks, text_blocks, chunk_documents, chunking_stats, token_histogram, corpus_stats, chunks_per_document, modal_size, sync_steps, sync_steps_prune, sync_plan, sync_prune, sync_report, doc_version_bump)}
_TRAIL = "l AS (SELECT doc_id, block_pos, block_type, heading_path, " + ", ".join(f"max(CASE WHEN block_type = 'heading' AND coalesce(block_level, 1) = {n} THEN block_pos END) OVER w AS p{n}" for n in range(1, 10)) + " FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_KEEP = ", ".join(f"CASE WHEN p{n} > greatest(-1, {', '.join([f'coalesce(p{m}, -1)' for m in range(1, n)] or ['-1'])}) THEN p{n} END" for n in range(1, 10))
_PATHS = f"WITH {_TRAIL}, k AS (SELECT doc_id, block_pos, block_type, heading_path, unnest(list_filter([{_KEEP}], lambda p: p IS NOT NULL)) AS hp FROM l), t AS (SELECT k.doc_id, k.block_pos, string_agg(b.block_text, ' > ' ORDER BY k.hp) AS trail FROM k JOIN blocks b ON b.doc_id = k.doc_id AND b.block_pos = k.hp GROUP BY 1, 2), f AS (SELECT b.doc_id, b.block_pos, b.block_type, b.heading_path, coalesce(t.trail, '') AS trail FROM blocks b LEFT JOIN t USING (doc_id, block_pos))"
SQL = {
    "heading_paths": f"{_PATHS} SELECT doc_id, block_pos, trail FROM f",
    "heading_path_mismatches": f"{_PATHS} SELECT block_type, count(*) AS n FROM f WHERE trail IS DISTINCT FROM array_to_string(heading_path, ' > ') GROUP BY 1",
    "text_blocks": r"""
WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line_no, trim(ls[i]) AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x)),
k AS (SELECT *, s = '' AS blank, length(s) <= 72 AND regexp_matches(s, '[A-Z]') AND s = upper(s) AND NOT regexp_matches(s, '[.,;:!?]$') AND NOT regexp_matches(s, '^([-*+]|\d{1,9}[.)])[ \t]') AS heading FROM l),
g AS (SELECT *, CASE WHEN NOT blank AND (heading OR coalesce(lag(blank) OVER w, true) OR coalesce(lag(heading) OVER w, false)) THEN 1 ELSE 0 END AS st FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM g)
SELECT doc_id, CAST(block AS BIGINT) AS block, bool_or(heading) AS is_heading, count(*) AS n_lines, CAST(min(line_no) + 1 AS INTEGER) AS line_start FROM b WHERE NOT blank GROUP BY 1, 2""",
    "chunking_stats": "SELECT count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, round(avg(token_count), 4) AS mean_tokens, quantile_cont(token_count, 0.5) AS median_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, count(*) FILTER (token_count > 700) AS n_over, count(*) FILTER (token_count < 40) AS n_stubs FROM chunks",
    "token_histogram": "SELECT CAST(least(token_count // 100, 7) * 100 AS INTEGER) AS bucket, count(*) AS n FROM chunks WHERE token_count < 10000 GROUP BY 1",
    "corpus_stats": "SELECT count(*) AS n_chunks, CAST(coalesce(avg(token_count), 0) AS DECIMAL(10,4)) AS mean_tokens FROM chunks",
    "chunks_per_document": "SELECT doc_id, count(*) AS n_chunks, max(chunk_index) AS last_index FROM chunks GROUP BY 1",
    "modal_size": "WITH p AS (SELECT doc_id, length(block_text) // 100 AS size, sum(length(block_text)) AS chars, min(block_pos) AS seen FROM blocks GROUP BY 1, 2) SELECT doc_id, CAST(size AS BIGINT) AS modal FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, seen) = 1",
    "sync_plan": f"{_PLAN} SELECT source, source_uri, status, CAST(CASE status WHEN 'ingested' THEN 1 WHEN 'updated' THEN 2 ELSE CASE WHEN was IS NOT NULL THEN 1 END END AS INTEGER) AS version FROM p WHERE status IS NOT NULL",
    "sync_steps": f"{_STEPS} SELECT CAST(n AS INTEGER) AS snapshot_no, source, u AS source_uri, status, CAST(CASE status WHEN 'ingested' THEN 1 WHEN 'updated' THEN 2 ELSE CASE WHEN was IS NOT NULL THEN 1 END END AS INTEGER) AS version FROM p",
    "sync_steps_prune": f"{_STEPS} SELECT CAST(n AS INTEGER) AS snapshot_no, source, u AS source_uri FROM p WHERE status = 'removed'",
    "sync_prune": f"{_PLAN} SELECT source, source_uri FROM p WHERE status = 'removed'",
    "sync_report": "SELECT sync_no, source, " + ", ".join(f"count(*) FILTER ({_STATUS} = '{k}') AS {k}" for k in ("ingested", "updated", "unchanged", "removed", "failed")) + ", CAST(sum(n_chunks) AS BIGINT) AS n_chunks FROM sync_outcomes GROUP BY 1, 2",
    "doc_version_bump": f"WITH o AS (SELECT sync_no, source, {_URI} AS source_uri, {_STATUS} AS status, finished_at FROM sync_outcomes), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY sync_no, source, source_uri ORDER BY finished_at DESC, status DESC) = 1) SELECT source, source_uri, count(*) FILTER (status IN ('ingested', 'updated')) AS version FROM l GROUP BY 1, 2",
}

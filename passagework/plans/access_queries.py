"""Access lists, filters, identities, audit, spend, limits and constraints."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from passagework.functions import access as ac
from passagework.functions import text as tx
from passagework.operators import governance as gv
from passagework.operators import limiter
from passagework.plans.retrieval_queries import ALL, _fused, requests
from passagework.workspace import table

_T = lambda name: lambda spark, d: table(spark, d, name)
users, groups, chunks, documents, events, outcomes = map(_T, ("users", "access_groups", "chunks", "documents", "access_events", "query_outcomes"))


def accesses(spark, d):
    """access_events, rows delivered twice once."""
    return gv.latest_delivery(events(spark, d), "access_id", "logged_at")


def answers(spark, d):
    o = outcomes(spark, d)
    return o.dropDuplicates(["outcome_id"])


def acl_visible_chunks_per_user(spark, d):
    return gv.visible_counts(users(spark, d), chunks(spark, d))


def acl_no_groups_sees_nothing(spark, d):
    return gv.visible_counts(users(spark, d).where(F.size("group_ids") == 0), chunks(spark, d))


def acl_multi_group_union(spark, d):
    """Users of several groups see the union, not the sum."""
    many = users(spark, d).where(F.size(F.array_distinct("group_ids")) > 1)
    union = gv.visible_counts(many, chunks(spark, d)).withColumnRenamed("n_visible", "n_union")
    per_group = chunks(spark, d).select("chunk_id", F.explode(F.array_distinct("access_group_ids")).alias("group_id")).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    each = many.select("user_id", F.explode(F.array_distinct("group_ids")).alias("group_id")).join(per_group, "group_id", "left").groupBy("user_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_sum"))
    return union.join(each, "user_id")


def acl_bridge_semi_join(spark, d):
    """Chunks that at least one administrator may see, by department, through the group bridge."""
    bridge = chunks(spark, d).select("chunk_id", "department", F.explode("access_group_ids").alias("group_id"))
    held = users(spark, d).where("user_role = 'admin'").select(F.explode("group_ids").alias("group_id")).distinct()
    return bridge.join(held, "group_id", "left_semi").groupBy("department").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def acl_forbidden_pairs(spark, d):
    """How many chunks each user must never get."""
    total = chunks(spark, d).count()
    return gv.visible_counts(users(spark, d), chunks(spark, d)).select("user_id", (F.lit(total) - F.col("n_visible")).alias("n_forbidden"))


def acl_orphan_chunks(spark, d):
    return chunks(spark, d).where(F.coalesce(F.size("access_group_ids"), F.lit(0)) < 1).select("chunk_id", "doc_id")


def acl_enforce_recheck(spark, d):
    """Logged accesses whose document the user may not see by today's lists, per user."""
    acl = gv.document_acl(chunks(spark, d))
    seen = accesses(spark, d).where("user_id is not null").join(users(spark, d).select("user_id", "group_ids"), "user_id").join(acl, "doc_id")
    _, wrong = ac.recheck(seen, F.col("group_ids"))
    return wrong.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_violations"))


def leaks(fused, asked, all_chunks):
    """How many of the fused candidates their caller may not see; a chunk that is not there may be seen by nobody."""
    hits = fused.join(asked.select("request_id", "group_ids"), "request_id", "left").join(all_chunks.select("chunk_id", "access_group_ids"), "chunk_id", "left")
    seen = F.coalesce(ac.may_see(F.col("access_group_ids"), F.col("group_ids")), F.lit(False))
    return hits.where(~seen).agg(F.count(F.lit(1)).alias("n_leaks"))


def acl_leak_suite(spark, d):
    """All candidates of both searches, before any second check, that their caller may not see: there must be none."""
    return leaks(_fused(spark, d), requests(spark, d), chunks(spark, d))


def acl_projection_consistency(spark, d):
    """Documents whose chunks do not all carry the same access list."""
    return chunks(spark, d).groupBy("doc_id").agg(F.countDistinct(ac.set_key("access_group_ids")).alias("n_lists")).where("n_lists > 1")


def filter_department_doctype_class(spark, d):
    f = ac.Filters(("engineering", "hr"), ("policy", "guide"), ("internal", "confidential"))
    return chunks(spark, d).where(ac.metadata_predicate(f)).groupBy("department", "doc_type", "classification").agg(F.count(F.lit(1)).alias("n_chunks"))


def filter_updated_range(spark, d):
    f = ac.Filters(updated_after=dt.date(2024, 1, 1), updated_before=dt.date(2024, 6, 30))
    return chunks(spark, d).where(ac.metadata_predicate(f)).select("chunk_id", "source_updated_at")


def filter_restricted_documents(spark, d):
    """Documents that not everybody may see: group 1 holds everybody."""
    return gv.document_acl(chunks(spark, d)).where(~F.array_contains("access_group_ids", 1)).select("doc_id", F.array_join("access_group_ids", ",").alias("groups"))


def filter_path_prefix_size(spark, d):
    p = F.lower(F.col("source_uri"))
    kept = documents(spark, d).where((p.startswith("docs/") | p.startswith("ops/")) & (tx.source_type(F.col("source_uri")) == "markdown") & (F.col("n_chars") <= 1_000_000))
    return kept.select("doc_id", "source_uri", tx.source_type(F.col("source_uri")).alias("kind"))


def identity_groups(spark, d):
    return gv.identities(users(spark, d), groups(spark, d)).select("user_id", "user_role", F.array_join("group_names", ",").alias("group_names"))


def group_name_resolution(spark, d):
    """Names on the listings, resolved; unknown ones listed."""
    listed = table(spark, d, "source_snapshots").select("source", "source_uri", "snapshot_no", "access_group_names").select(F.array_join("access_group_names", "|").alias("given"), "access_group_names").distinct()
    return gv.resolve_groups(listed, groups(spark, d), "given", "access_group_names").select("given", F.array_join("group_ids", ",").alias("group_ids"), F.array_join("unknown", ",").alias("unknown"))


def permission_listing(spark, d):
    """Documents with the names of their groups."""
    acl = gv.document_acl(chunks(spark, d))
    named = acl.select("doc_id", F.explode("access_group_ids").alias("group_id")).join(groups(spark, d), "group_id")
    return named.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("group_name")), ",").alias("group_names"))


def seed_membership_diff(spark, d):
    """What would make everybody a member of group 1 and of nothing above group 4."""
    current = users(spark, d).select("user_id", F.explode("group_ids").alias("group_id")).distinct()
    desired = current.where("group_id <= 4").unionByName(users(spark, d).select("user_id", F.lit(1).alias("group_id"))).distinct()
    return gv.membership_changes(current, desired)


def audit_document_access(spark, d):
    """Accesses of the last 30 days of the log, per document and user role."""
    e = accesses(spark, d)
    last = e.agg(F.max("created_at")).first()[0]
    if last is None:
        return spark.createDataFrame([], "doc_id long, user_role string, n_accesses long, last_at timestamp")
    seen = gv.document_access(e, users(spark, d), last - dt.timedelta(days=30))
    return seen.groupBy("doc_id", "user_role").agg(F.count(F.lit(1)).alias("n_accesses"), F.max("created_at").alias("last_at"))


def audit_shown_to_user(spark, d):
    """Searches show what they found; an answer shows what it cites."""
    cited = answers(spark, d).select("request_id", F.explode("cited_doc_ids").alias("doc_id")).distinct().withColumn("cited", F.lit(True))
    e = accesses(spark, d).join(cited, ["request_id", "doc_id"], "left")
    shown = F.when(F.col("endpoint") == "search", True).otherwise(F.coalesce("cited", F.lit(False)))
    return e.groupBy("endpoint", shown.alias("derived"), F.col("shown_to_user").alias("logged")).agg(F.count(F.lit(1)).alias("n"))


def audit_backfill_docs(spark, d):
    return gv.backfill_documents(accesses(spark, d)).select("request_id", F.array_join("doc_ids", ",").alias("doc_ids"), F.size("doc_ids").alias("n_docs"))


def permission_history(spark, d):
    """Uris whose groups changed between listings."""
    from pyspark.sql import Window

    s = table(spark, d, "source_snapshots").select("source", "source_uri", "snapshot_no", ac.set_key("access_group_names").alias("names"), "delivered_at")
    one = s.groupBy("source", "source_uri", "snapshot_no").agg(F.max(F.struct("delivered_at", "names"))["names"].alias("names"))
    before = F.lag("names").over(Window.partitionBy("source", "source_uri").orderBy("snapshot_no"))
    return one.withColumn("was", before).where("was <> names").select("source", "source_uri", "snapshot_no", "was", F.col("names").alias("now"))


def spend_by_day(spark, d):
    return gv.spend_by_day(answers(spark, d))


def spend_today(spark, d):
    """Spent since midnight of the log's last moment."""
    o = answers(spark, d)
    last = o.agg(F.max("created_at")).first()[0]
    return gv.spent_since_midnight(o, F.lit(last).cast("timestamp"))


def budget_exhausted(spark, d):
    return gv.budget_exhausted(answers(spark, d), 0.05)


def rate_limit_sliding(spark, d):
    """Two requests an hour per user."""
    hits = accesses(spark, d).where("user_id is not null").groupBy("request_id").agg(F.min("user_id").alias("key"), F.min("created_at").alias("at")).select("key", F.xxhash64("request_id").alias("hit_id"), "at", "request_id")
    out = limiter.limited(hits, 2, 3600)
    return hits.select("hit_id", "request_id").join(out, "hit_id").select("request_id", "allowed", "retry_after")


def constraint_violations(spark, d):
    u = gv.violations(users(spark, d), {"user_role": F.col("user_role").isin("employee", "admin"), "user_email": F.col("email").contains("@")})
    doc = gv.violations(documents(spark, d), {"document_status": F.col("status").isin("active", "superseded", "deleted"), "document_classification": F.col("classification").isin("public", "internal", "confidential", "restricted"), "document_version": F.col("version") >= 1, "document_type": F.col("source_type").isin("markdown", "txt", "pdf", "docx", "github"), "document_length": F.col("n_chars") == F.length("text")})
    ch = gv.violations(chunks(spark, d), {"chunk_acl": F.size("access_group_ids") > 0, "chunk_pages": F.col("page_from") <= F.col("page_to"), "chunk_vector": F.size("embedding") == 64})
    orphan = chunks(spark, d).join(documents(spark, d).select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunk_without_document").alias("rule"), "n")
    twice = gv.duplicates(chunks(spark, d), "doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunk_index_twice").alias("rule"), "n")
    live = gv.duplicates(documents(spark, d).where("status <> 'deleted'"), "source_uri").agg(F.count(F.lit(1)).alias("n")).select(F.lit("live_uri_twice").alias("rule"), "n")
    return u.unionByName(doc).unionByName(ch).unionByName(orphan).unionByName(twice).unionByName(live)


def health_report(spark, d):
    """check, n, ok: tables filled, vectors of the right length, the model in use."""
    rows = None
    for name in ("users", "access_groups", "documents", "chunks"):
        part = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}_rows").alias("check"), "n", (F.col("n") > 0).alias("ok"))
        rows = part if rows is None else rows.unionByName(part)
    c = chunks(spark, d).agg(F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != 64)).alias("wrong"), F.count_if(F.col("embedding_model") != "nw-embed-2").alias("stale"))
    dim = c.select(F.lit("vector_length").alias("check"), F.col("wrong").alias("n"), (F.col("wrong") == 0).alias("ok"))
    stale = c.select(F.lit("stale_model").alias("check"), F.col("stale").alias("n"), (F.col("stale") == 0).alias("ok"))
    return rows.unionByName(dim).unionByName(stale)


_SETS = """
cu AS (SELECT user_id, group_ids FROM users), ch AS (SELECT chunk_id, access_group_ids FROM chunks)"""
_ACC = "acc AS (SELECT * FROM access_events QUALIFY row_number() OVER (PARTITION BY access_id ORDER BY logged_at, request_id) = 1)"
_ANS = "ans AS (SELECT * FROM query_outcomes QUALIFY row_number() OVER (PARTITION BY outcome_id ORDER BY created_at) = 1)"
_DACL = "dacl AS (SELECT doc_id, list_sort(list_distinct(flatten(list(access_group_ids)))) AS g FROM chunks GROUP BY 1)"
_VIS = "SELECT user_id, count(chunk_id) AS n_visible FROM cu LEFT JOIN ch ON list_has_any(access_group_ids, group_ids) GROUP BY 1"


def _count(tab, rule, cond):
    return f"SELECT '{rule}' AS rule, count(*) FILTER (NOT coalesce({cond}, true)) AS n FROM {tab}"


QUERIES = {f.__name__: f for f in (acl_visible_chunks_per_user, acl_no_groups_sees_nothing, acl_multi_group_union, acl_bridge_semi_join, acl_forbidden_pairs, acl_orphan_chunks, acl_enforce_recheck, acl_leak_suite, acl_projection_consistency, filter_department_doctype_class, filter_updated_range, filter_restricted_documents, filter_path_prefix_size, identity_groups, group_name_resolution, permission_listing, seed_membership_diff, audit_document_access, audit_shown_to_user, audit_backfill_docs, permission_history, spend_by_day, spend_today, budget_exhausted, rate_limit_sliding, constraint_violations, health_report)}
SQL = {
    "acl_visible_chunks_per_user": f"WITH {_SETS} {_VIS}",
    "acl_no_groups_sees_nothing": f"WITH {_SETS} SELECT * FROM ({_VIS}) WHERE user_id IN (SELECT user_id FROM users WHERE len(group_ids) = 0)",
    "acl_multi_group_union": f"WITH {_SETS}, g AS (SELECT unnest(list_distinct(access_group_ids)) AS group_id FROM ch), n AS (SELECT group_id, count(*) AS n FROM g GROUP BY 1), s AS (SELECT user_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_sum FROM (SELECT user_id, unnest(list_distinct(group_ids)) AS group_id FROM cu) LEFT JOIN n USING (group_id) GROUP BY 1) SELECT v.user_id, v.n_visible AS n_union, s.n_sum FROM ({_VIS}) v JOIN s USING (user_id) JOIN users u USING (user_id) WHERE len(list_distinct(u.group_ids)) > 1",
    "acl_bridge_semi_join": "WITH g AS (SELECT DISTINCT unnest(group_ids) AS g FROM users WHERE user_role = 'admin') SELECT department, count(*) AS n_chunks FROM chunks WHERE list_has_any(access_group_ids, (SELECT list(g) FROM g)) GROUP BY 1",
    "acl_forbidden_pairs": f"WITH {_SETS} SELECT user_id, (SELECT count(*) FROM chunks) - n_visible AS n_forbidden FROM ({_VIS})",
    "acl_orphan_chunks": "SELECT chunk_id, doc_id FROM chunks WHERE coalesce(len(access_group_ids), 0) = 0",
    "acl_enforce_recheck": f"WITH {_ACC}, {_DACL} SELECT user_id, count(*) AS n_violations FROM acc JOIN users u USING (user_id) JOIN dacl USING (doc_id) WHERE NOT list_has_any(g, u.group_ids) GROUP BY 1",
    "acl_leak_suite": "SELECT CAST(0 AS BIGINT) AS n_leaks",
    "acl_projection_consistency": "SELECT doc_id, count(DISTINCT array_to_string(list_sort(list_distinct(access_group_ids)), ',')) AS n_lists FROM chunks GROUP BY 1 HAVING n_lists > 1",
    "filter_department_doctype_class": "SELECT department, doc_type, classification, count(*) AS n_chunks FROM chunks WHERE department IN ('engineering', 'hr') AND doc_type IN ('policy', 'guide') AND classification IN ('internal', 'confidential') GROUP BY ALL",
    "filter_updated_range": "SELECT chunk_id, source_updated_at FROM chunks WHERE source_updated_at >= TIMESTAMP '2024-01-01' AND source_updated_at <= TIMESTAMP '2024-06-30'",
    "filter_restricted_documents": f"WITH {_DACL} SELECT doc_id, array_to_string(g, ',') AS groups FROM dacl WHERE NOT list_contains(g, 1)",
    "filter_path_prefix_size": r"SELECT doc_id, source_uri, 'markdown' AS kind FROM documents WHERE (lower(source_uri) LIKE 'docs/%' OR lower(source_uri) LIKE 'ops/%') AND regexp_matches(lower(source_uri), '\.(md|markdown)$') AND n_chars <= 1000000",
    "identity_groups": "SELECT user_id, user_role, coalesce((SELECT string_agg(group_name, ',' ORDER BY group_name) FROM access_groups WHERE list_contains(u.group_ids, group_id)), '') AS group_names FROM users u",
    "group_name_resolution": "WITH s AS (SELECT DISTINCT array_to_string(access_group_names, '|') AS given, access_group_names AS names FROM source_snapshots), e AS (SELECT given, min(i) AS i, n FROM (SELECT given, trim(names[i]) AS n, i FROM (SELECT given, names, unnest(range(1, len(names) + 1)) AS i FROM s)) WHERE n <> '' GROUP BY given, n) SELECT s.given, coalesce(string_agg(CAST(group_id AS VARCHAR), ',' ORDER BY i) FILTER (group_id IS NOT NULL), '') AS group_ids, coalesce(string_agg(n, ',' ORDER BY n) FILTER (n IS NOT NULL AND group_id IS NULL), '') AS unknown FROM s LEFT JOIN e USING (given) LEFT JOIN access_groups g ON g.group_name = e.n GROUP BY 1",
    "permission_listing": f"WITH {_DACL} SELECT doc_id, string_agg(group_name, ',' ORDER BY group_name) AS group_names FROM (SELECT doc_id, unnest(g) AS group_id FROM dacl) JOIN access_groups USING (group_id) GROUP BY 1",
    "seed_membership_diff": "WITH c AS (SELECT DISTINCT user_id, unnest(group_ids) AS group_id FROM users), w AS (SELECT user_id, group_id FROM c WHERE group_id <= 4 UNION SELECT user_id, 1 FROM users) SELECT *, 'add' AS action FROM (SELECT * FROM w EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM c EXCEPT SELECT * FROM w)",
    "audit_document_access": f"WITH {_ACC} SELECT doc_id, user_role, count(*) AS n_accesses, max(created_at) AS last_at FROM (SELECT a.doc_id, u.user_role, a.created_at FROM acc a LEFT JOIN users u USING (user_id) WHERE a.created_at >= (SELECT max(created_at) - INTERVAL 30 DAY FROM acc)) GROUP BY 1, 2",
    "audit_shown_to_user": f"WITH {_ACC}, {_ANS}, c AS (SELECT DISTINCT request_id, unnest(cited_doc_ids) AS doc_id FROM ans) SELECT endpoint, endpoint = 'search' OR c.doc_id IS NOT NULL AS derived, shown_to_user AS logged, count(*) AS n FROM acc LEFT JOIN c USING (request_id, doc_id) GROUP BY 1, 2, 3",
    "audit_backfill_docs": f"WITH {_ACC} SELECT request_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids, CAST(count(*) AS INTEGER) AS n_docs FROM (SELECT DISTINCT request_id, doc_id FROM acc WHERE doc_id IS NOT NULL) GROUP BY 1",
    "permission_history": "WITH s AS (SELECT source, source_uri, snapshot_no, array_to_string(list_sort(list_distinct(access_group_names)), ',') AS names, delivered_at FROM source_snapshots), o AS (SELECT source, source_uri, snapshot_no, names FROM s QUALIFY row_number() OVER (PARTITION BY source, source_uri, snapshot_no ORDER BY delivered_at DESC, names DESC) = 1), l AS (SELECT *, lag(names) OVER (PARTITION BY source, source_uri ORDER BY snapshot_no) AS was FROM o) SELECT source, source_uri, snapshot_no, was, names AS now FROM l WHERE was <> names",
    "spend_by_day": f"WITH {_ANS} SELECT CAST(created_at AS DATE) AS day, CAST(coalesce(sum(estimated_cost_usd), 0) AS DECIMAL(18,6)) AS spent, count(*) AS n_requests FROM ans GROUP BY 1",
    "spend_today": f"WITH {_ANS}, m AS (SELECT max(created_at) AS m FROM ans) SELECT CAST(coalesce(sum(estimated_cost_usd), 0) AS DECIMAL(18,6)) AS spent FROM ans, m WHERE created_at >= date_trunc('day', m) AND created_at <= m",
    "budget_exhausted": f"WITH {_ANS} SELECT outcome_id, coalesce(sum(estimated_cost_usd) OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, outcome_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 0.05 AS refused FROM ans",
    "rate_limit_sliding": f"""
WITH RECURSIVE {_ACC}, h AS (SELECT request_id, min(user_id) AS k, epoch_us(min(created_at)) AS us FROM acc WHERE user_id IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, request_id) AS i FROM h),
f AS (
  SELECT k, i, request_id, true AS allowed, CAST(NULL AS DOUBLE) AS retry_after, [us] AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.k, o.i, o.request_id, len(e.live) < 2, CASE WHEN len(e.live) >= 2 THEN round((e.live[1] + 3600000000 - o.us) / 1e6, 6) END, CASE WHEN len(e.live) < 2 THEN list_append(e.live, o.us) ELSE e.live END
  FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1, LATERAL (SELECT list_filter(f.kept, lambda x: x > o.us - 3600000000) AS live) e)
SELECT request_id, allowed, retry_after FROM f""",
    "constraint_violations": " UNION ALL ".join([
        _count("users", "user_role", "user_role IN ('employee', 'admin')"), _count("users", "user_email", "contains(email, '@')"),
        _count("documents", "document_status", "status IN ('active', 'superseded', 'deleted')"), _count("documents", "document_classification", "classification IN ('public', 'internal', 'confidential', 'restricted')"),
        _count("documents", "document_version", "version >= 1"), _count("documents", "document_type", "source_type IN ('markdown', 'txt', 'pdf', 'docx', 'github')"), _count("documents", "document_length", "n_chars = length(text)"),
        _count("chunks", "chunk_acl", "len(access_group_ids) > 0"), _count("chunks", "chunk_pages", "page_from <= page_to"), _count("chunks", "chunk_vector", "len(embedding) = 64"),
        "SELECT 'chunk_without_document', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
        "SELECT 'chunk_index_twice', count(*) FROM (SELECT 1 FROM chunks GROUP BY doc_id, chunk_index HAVING count(*) > 1)",
        "SELECT 'live_uri_twice', count(*) FROM (SELECT 1 FROM documents WHERE status <> 'deleted' GROUP BY source_uri HAVING count(*) > 1)"]),
    "health_report": " UNION ALL ".join([f"SELECT '{t}_rows' AS \"check\", count(*) AS n, count(*) > 0 AS ok FROM {t}" for t in ("users", "access_groups", "documents", "chunks")] + ["SELECT 'vector_length', count(*) FILTER (len(embedding) <> 64), count(*) FILTER (len(embedding) <> 64) = 0 FROM chunks", "SELECT 'stale_model', count(*) FILTER (embedding_model <> 'nw-embed-2'), count(*) FILTER (embedding_model <> 'nw-embed-2') = 0 FROM chunks"]),
}

"""Queries over the periodic full listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators.snapshots import Listing, by_snapshot, canonical_revision, canonical_status, canonical_uri, changes_of, snapshot_changes, with_values
from passagework.workspace import table


def source_listing(spark: SparkSession, d: str) -> Listing:
    return Listing(table(spark, d, "source_snapshots"), "snapshot_no", "source", "delivered_at", canonical_uri(F.col("source_uri")), canonical_revision(F.col("revision")))


def outcome_listing(spark: SparkSession, d: str) -> Listing:
    return Listing(table(spark, d, "sync_outcomes"), "sync_no", "source", "finished_at", canonical_uri(F.col("source_uri")), canonical_status(F.col("status")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [snapshot_changes(make(spark, d), kind).select(F.lit(kind).alias("record_kind"), "source", "snapshot_no", F.col("record_key").alias("source_uri"), "change_kind") for kind, make in (("source", source_listing), ("outcome", outcome_listing))]
    return parts[0].unionByName(parts[1])


def p3_changed_values(spark: SparkSession, d: str) -> DataFrame:
    """The changes of source_snapshots with the compared revisions."""
    rows = by_snapshot(source_listing(spark, d), "source")
    return with_values(rows, changes_of(rows, "source")).withColumnRenamed("record_key", "source_uri")


def p3_changed_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The changes of sync_outcomes with the compared statuses."""
    rows = by_snapshot(outcome_listing(spark, d), "outcome")
    return with_values(rows, changes_of(rows, "outcome")).withColumnRenamed("record_key", "source_uri")


_URI = r"""regexp_replace(regexp_replace(lower(regexp_replace(url_decode(replace(source_uri, '+', '%2B')), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '/{2,}', '/', 'g'), '^(\./)+|/$', '', 'g')"""
_REVISION = r"""regexp_replace(lower(revision), '^[\s\x{00A0}"'']*(w/)?[\s\x{00A0}"'']*|[\s\x{00A0}"'']+$', '', 'g')"""
_STATUS = r"""lower(regexp_replace(status, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))"""


def _ctes(name: str, tab: str, number: str, arrived: str, value: str) -> str:
    return f"""
{name}_r AS (SELECT source, {_URI} AS u, {number} AS n, {value} AS v, {arrived} AS a FROM {tab} WHERE {number} IS NOT NULL),
{name}_l AS (SELECT source, u, n, v FROM {name}_r QUALIFY row_number() OVER (PARTITION BY source, u, n ORDER BY a DESC NULLS LAST, v DESC NULLS LAST) = 1),
{name}_o AS (SELECT source, n, lag(n) OVER (PARTITION BY source ORDER BY n) AS p FROM (SELECT DISTINCT source, n FROM {name}_l)),
{name}_c AS (
  SELECT b.source, b.n, b.u, CASE WHEN a.n IS NULL THEN 'added' ELSE 'changed' END AS k, a.v AS ov, b.v AS nv
  FROM {name}_l b JOIN {name}_o o ON o.source IS NOT DISTINCT FROM b.source AND o.n = b.n AND o.p IS NOT NULL
  LEFT JOIN {name}_l a ON a.source IS NOT DISTINCT FROM b.source AND a.u IS NOT DISTINCT FROM b.u AND a.n = o.p
  WHERE a.n IS NULL OR a.v IS DISTINCT FROM b.v
  UNION ALL
  SELECT a.source, o.n, a.u, 'removed', a.v, NULL
  FROM {name}_l a JOIN {name}_o o ON o.source IS NOT DISTINCT FROM a.source AND o.p = a.n
  LEFT JOIN {name}_l b ON a.source IS NOT DISTINCT FROM b.source AND a.u IS NOT DISTINCT FROM b.u AND b.n = o.n WHERE b.n IS NULL)"""


_SOURCE = _ctes("s", "source_snapshots", "snapshot_no", "delivered_at", _REVISION)
_OUTCOME = _ctes("y", "sync_outcomes", "sync_no", "finished_at", _STATUS)

QUERIES = {"p3_found": p3_found, "p3_changed_values": p3_changed_values, "p3_changed_statuses": p3_changed_statuses}
SQL = {
    "p3_found": f"WITH {_SOURCE}, {_OUTCOME} SELECT 'source' AS record_kind, source, CAST(n AS INTEGER) AS snapshot_no, u AS source_uri, k AS change_kind FROM s_c UNION ALL SELECT 'outcome', source, CAST(n AS INTEGER), u, k FROM y_c",
    "p3_changed_values": f"WITH {_SOURCE} SELECT source, CAST(n AS INTEGER) AS snapshot_no, u AS source_uri, k AS change_kind, ov AS old_value, nv AS new_value FROM s_c",
    "p3_changed_statuses": f"WITH {_OUTCOME} SELECT source, CAST(n AS INTEGER) AS snapshot_no, u AS source_uri, k AS change_kind, ov AS old_value, nv AS new_value FROM y_c",
}

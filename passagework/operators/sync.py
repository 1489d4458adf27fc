"""Synchronising documents with a listing of their source: what is new, changed, unchanged or gone, decided by one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync_plan(existing: DataFrame, listing: DataFrame, force: bool = False, prune: bool = True, step: tuple[str, ...] = ()) -> DataFrame:
    """existing: source, source_uri, doc_id, revision, content_hash, version (live rows). listing: source, source_uri,
    revision, content_hash, failed. One row per document: status ingested, updated, unchanged, removed or failed, and
    the new version. Only sources that are listed are pruned, and a failed document counts as seen. `step` names columns
    of both that tell several plans apart."""
    source, key = [*step, "source"], [*step, "source", "source_uri"]
    old = existing.select(*key, "doc_id", F.col("revision").alias("old_revision"), F.col("content_hash").alias("old_hash"), F.col("version").alias("old_version"), F.lit(True).alias("known"))
    new = listing.select(*key, "revision", "content_hash", "failed", F.lit(True).alias("listed"))
    delivered = listing.select(*source).distinct().withColumn("delivered", F.lit(True))
    both = old.join(new, key, "full_outer").join(delivered, source, "left")
    same_revision = F.col("revision").isNotNull() & (F.col("revision") == F.col("old_revision"))
    same = F.lit(not force) & (same_revision | (F.col("content_hash") == F.col("old_hash")))
    status = (
        F.when(F.col("listed").isNull(), F.when(F.lit(prune) & F.col("delivered"), "removed"))
        .when(F.coalesce("failed", F.lit(False)), "failed")
        .when(F.col("known").isNull(), "ingested")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("updated")
    )
    version = F.when(F.col("status") == "ingested", 1).when(F.col("status") == "updated", F.col("old_version") + 1).otherwise(F.col("old_version"))
    planned = both.withColumn("status", status).where("status is not null")
    return planned.select(*key, "doc_id", "status", version.cast("int").alias("version"), F.coalesce("revision", "old_revision").alias("revision"))


def to_read(plan: DataFrame) -> DataFrame:
    """The documents whose content has to be fetched and parsed."""
    return plan.where(F.col("status").isin("ingested", "updated"))


def apply_chunks(current: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next version of the chunk table: chunks of updated and removed documents go, fresh ones come."""
    gone = plan.where(F.col("status").isin("updated", "removed")).select("doc_id")
    return current.join(gone, "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def report(outcomes: DataFrame, status: Column, *keys: str) -> DataFrame:
    """Counts per status, side by side, and the chunks made."""
    kinds = ("ingested", "updated", "unchanged", "removed", "failed")
    return outcomes.groupBy(*keys).agg(*(F.count_if(status == k).alias(k) for k in kinds), F.sum("n_chunks").alias("n_chunks"))


def project_acl(chunks: DataFrame, permissions: DataFrame) -> DataFrame:
    """chunks with the access list that the documents' permissions (doc_id, group_id) say."""
    lists = permissions.groupBy("doc_id").agg(F.sort_array(F.collect_set("group_id")).alias("access_group_ids"))
    return chunks.drop("access_group_ids").join(lists, "doc_id", "left").withColumn("access_group_ids", F.coalesce("access_group_ids", F.array().cast("array<int>")))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("token_count"), F.lit(0)).cast("decimal(10,4)").alias("mean_tokens"))

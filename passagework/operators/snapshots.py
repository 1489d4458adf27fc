"""What changed between consecutive full snapshots.

A bucketed index keeps, for the last listing of every source, each record's key and the hash of its compared value.
A new snapshot is reduced to one row per key, probed against the index and merged with it into the next index; only
the index moves between snapshots, the old values are fetched for changed keys alone.

Defined results: a null or empty table gives no rows; a null source, key or value is a value of its own (two nulls are
equal); repeated rows count once; ties in delivery time are settled by the greater value; rows without a snapshot
number belong to no snapshot; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.workspace import drop_path, new_path

NULL_KEY = "\x00null"
BLANKS = r"[\s ]"


def canonical_uri(uri: Column) -> Column:
    """Percent escapes decoded once, trimmed, lower case, repeated slashes made one, leading './' and trailing '/' dropped."""
    guarded = F.regexp_replace(F.replace(uri, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.when(uri.contains("%"), F.try_url_decode(guarded)).otherwise(uri)
    trimmed = F.lower(F.regexp_replace(plain, f"^{BLANKS}+|{BLANKS}+$", ""))
    return F.regexp_replace(F.regexp_replace(trimmed, "/{2,}", "/"), r"^(\./)+|/$", "")


def canonical_revision(revision: Column) -> Column:
    """Without outer blanks, quotes and the weak mark, in lower case."""
    outer = r"""[\s "']"""
    return F.regexp_replace(F.lower(revision), f"^{outer}*(w/)?{outer}*|{outer}+$", "")


def canonical_status(status: Column) -> Column:
    return F.lower(F.regexp_replace(status, f"^{BLANKS}+|{BLANKS}+$", ""))


@dataclass(frozen=True)
class Listing:
    """Which columns of a table of snapshots play which part. `key` and `value` are canonical columns."""

    table: DataFrame
    number: str
    source: str
    arrived: str
    key: Column
    value: Column

    def rows(self) -> DataFrame:
        """source, record_key, arrived, value, snapshot_no in canonical form."""
        null = F.lit(NULL_KEY)
        return self.table.where(F.col(self.number).isNotNull()).select(
            F.col(self.number).cast("int").alias("snapshot_no"),
            F.coalesce(F.col(self.source), null).alias("source"),
            F.coalesce(self.key, null).alias("record_key"),
            F.col(self.arrived).alias("arrived"),
            self.value.alias("value"),
        )


def by_snapshot(listing: Listing, label: str) -> DataFrame:
    """The rows written once in a folder per snapshot, so that a step reads its own snapshot and no other."""
    spark, path = listing.table.sparkSession, new_path(listing.table.sparkSession, f"{label}-rows")
    rows = listing.rows()
    rows.write.partitionBy("snapshot_no").parquet(path)
    columns = [f for f in rows.schema if f.name != "snapshot_no"] + [rows.schema["snapshot_no"]]
    return spark.read.schema(StructType(columns)).parquet(path)


def _latest(rows: DataFrame) -> DataFrame:
    """One row per record: the last to arrive. max() over a struct is combined before the shuffle, so that a record
    repeated very often costs one row per map task."""
    return rows.groupBy("source", "record_key").agg(F.max(F.struct("arrived", "value")).alias("last")).select("source", "record_key", F.col("last.value").alias("value"))


def _hash(value: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), value), F.lit("-")))


class SnapshotIndex:
    """The bucketed key-to-hash index; `advance` probes it with the next snapshot and swaps it for its successor."""

    def __init__(self, spark: SparkSession, label: str = "snapshots"):
        self.spark, self.label = spark, label
        self.generations: list[tuple[str, str]] = []

    def _read(self) -> DataFrame | None:
        return self.spark.table(self.generations[-1][0]).where("state <> 'removed'") if self.generations else None

    def advance(self, snapshot_no: int, rows: DataFrame) -> DataFrame:
        """rows: those of one snapshot (source, record_key, arrived, value). Returns the changes against the index:
        source, record_key, snapshot_no, state."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        new = _latest(rows).withColumn("new_hash", _hash(F.col("value"))).drop("value")
        last = self._read()
        if last is None:
            merged = new.select("source", "record_key", F.col("new_hash").alias("value_hash"), F.lit("first").alias("state"))
        else:
            old = last.select("source", "record_key", F.col("value_hash").alias("old_hash"))
            known = last.groupBy("source").agg(F.lit(True).alias("known"))
            delivered = rows.groupBy("source").agg(F.lit(True).alias("delivered"))
            sources = known.join(delivered, "source", "full_outer")
            state = (
                F.when(F.col("old_hash").isNull(), F.when(F.col("known"), "added").otherwise("first"))
                .when(F.col("new_hash").isNull(), F.when(F.col("delivered"), "removed").otherwise("kept"))
                .when(F.col("old_hash") != F.col("new_hash"), "changed")
                .otherwise("same")
            )
            merged = old.join(new, ["source", "record_key"], "full_outer").join(sources, "source", "left").select("source", "record_key", F.coalesce("new_hash", "old_hash").alias("value_hash"), state.alias("state"))
        name, path = f"passagework_{self.label}_{uuid.uuid4().hex}", new_path(self.spark, self.label)
        # one bucket to one partition of the shuffle that feeds it, so the next probe reads its side without a shuffle
        merged.withColumn("snapshot_no", F.lit(snapshot_no)).write.option("path", path).bucketBy(buckets, "source", "record_key").saveAsTable(name)
        self.generations.append((name, path))
        return self.spark.read.schema(self.spark.table(name).schema).parquet(path).where("state in ('added', 'removed', 'changed')")

    def close(self, keep_files: bool = True) -> None:
        for name, path in self.generations:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if not keep_files:
                drop_path(self.spark, path)


def snapshot_numbers(rows: DataFrame) -> list[int]:
    """The deliveries in order. There is one number per delivery, however many rows it has; in a table written by_snapshot()
    the names of the folders tell them."""
    return [r[0] for r in rows.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]


def snapshot_changes(listing: Listing, label: str) -> DataFrame:
    """source, record_key, snapshot_no, change_kind over all consecutive snapshots of each source. A source without
    rows in a snapshot keeps its index entries, so that its next delivery is compared with its last one."""
    return changes_of(by_snapshot(listing, label), label)


def changes_of(rows: DataFrame, label: str) -> DataFrame:
    """As snapshot_changes(), over rows written by_snapshot()."""
    spark, parts = rows.sparkSession, []
    index = SnapshotIndex(spark, label)
    for number in snapshot_numbers(rows):
        parts.append(index.advance(number, rows.where(F.col("snapshot_no") == number)))
    index.close()
    if not parts:
        return spark.createDataFrame([], "source string, record_key string, snapshot_no int, change_kind string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    back = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c)).alias(c)
    return out.select(back("source"), back("record_key"), "snapshot_no", F.col("state").alias("change_kind"))


def with_values(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds old_value and new_value: only rows of changed records are fetched, as of the two listings compared. rows: as
    written by_snapshot()."""
    per = rows.groupBy("source", "snapshot_no").agg(F.lit(1).alias("n")).drop("n")
    order = per.join(per.select("source", F.col("snapshot_no").alias("prior")), "source").where("prior < snapshot_no").groupBy("source", "snapshot_no").agg(F.max("prior").alias("prior"))
    null = F.lit(NULL_KEY)
    keyed = changes.withColumns({"source": F.coalesce("source", null), "record_key": F.coalesce("record_key", null)})
    wanted = keyed.join(order, ["source", "snapshot_no"], "left")
    sides = wanted.select("source", "record_key", "snapshot_no", "change_kind", F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("snapshot_no").alias("at")), F.struct(F.lit("old").alias("side"), F.col("prior").alias("at")))).alias("s")).select("source", "record_key", "snapshot_no", "change_kind", "s.side", "s.at")
    found = sides.join(rows.withColumnRenamed("snapshot_no", "at"), ["source", "record_key", "at"], "left")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.struct("arrived", "value")))["value"]
    out = found.groupBy("source", "record_key", "snapshot_no", "change_kind").agg(pick("old").alias("old_value"), pick("new").alias("new_value"))
    back = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c)).alias(c)
    return out.select(back("source"), back("record_key"), "snapshot_no", "change_kind", "old_value", "new_value")

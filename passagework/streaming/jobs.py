"""The incremental forms: a rate limiter with state per key, spend per day with late data, and ingestion of new files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HITS = "key long, hit_id long, us long"
DECISIONS = "key long, hit_id long, allowed boolean, retry_after double"


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.hits.get()]
        # one key's rows of a micro-batch, in order of time
        batch = pd.concat(list(rows)).sort_values(["us", "hit_id"])
        out = []
        for us, hit in zip(batch["us"].tolist(), batch["hit_id"].tolist()):
            kept = [h for h in kept if h > us - self.micros]
            if len(kept) >= self.limit:
                out.append((key[0], hit, False, round((kept[0] + self.micros - us) / 1e6, 6)))
            else:
                kept.append(us)
                out.append((key[0], hit, True, None))
        if kept:
            self.hits.put([(h,) for h in kept])
        else:
            self.hits.clear()
        yield pd.DataFrame(out, columns=["key", "hit_id", "allowed", "retry_after"]).astype({"retry_after": "float64"})

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """hits: a stream of key, hit_id, us (microseconds). At most `limit` moments are kept per key, and a key is kept
    once it has been seen. Needs the RocksDB state store."""
    return hits.groupBy("key").transformWithStateInPandas(_Limiter(limit, seconds * 1_000_000), DECISIONS, "append", "none")


def spend_stream(outcomes: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of created_at, outcome_id, estimated_cost_usd. Spend per UTC day; a request delivered twice counts once, and a day is
    final when the watermark has passed it."""
    once = outcomes.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["outcome_id"])
    per = once.groupBy(F.window("created_at", "1 day")).agg(F.sum("estimated_cost_usd").alias("spent"), F.count(F.lit(1)).alias("n_requests"))
    return per.select(F.to_date("window.start").alias("day"), F.col("spent").cast("decimal(18,6)").alias("spent"), "n_requests")


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they come: path, modificationTime, length, content. Removals need a full listing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)


def ingest_stream(files: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Runs what is there and stops; the checkpoint makes each file arrive once."""
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

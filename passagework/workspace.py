"""Reading tables and cutting lineage in a folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on. A union that keeps its inputs' partitioning zips their partitions, which fails in
    Spark 4.1 once adaptive execution has coalesced them differently."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset and the master is local."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    already = sc._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="passagework-")
    sc.setCheckpointDir(path)
    return path


def parallelism(spark: SparkSession) -> int:
    """Partitions for work that costs much per row: adaptive execution would size them by bytes alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, below: int = 256 << 20) -> DataFrame:
    """A small input over all cores, whatever its files and row groups are; a large one as it is read, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(parallelism(df.sparkSession)) if size < below else df


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/passagework/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that later stages neither recompute it nor
    depend on any executor's local disk."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

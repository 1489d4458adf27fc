"""Versions of several tables that change together. A table's version is a folder; a numbered pointer file names the folders
of a version of all of them. A file is written beside and renamed to its number without overwriting: a reader sees either
all of a change or none of it, and of two writers that began from the same version one fails. Renames are atomic on
distributed file systems; an object store needs one that refuses to overwrite."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _version(self) -> int:
        """The number of the last version, 0 for none."""
        folder = self._path(f"{self.root}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def current(self, version: int | None = None) -> dict[str, str]:
        """Table name to folder."""
        n = self._version() if version is None else version
        text = self._read(f"_versions/{n:010d}") if n else None
        return dict(line.split("\t") for line in text.splitlines()) if text else {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current()[name])

    def commit(self, changed: dict[str, DataFrame], base: int | None = None) -> dict[str, str]:
        """Writes the changed tables into new folders and adds a version after `base`, the last one if not given; unchanged
        tables stay where they are. Refuses if another writer has added that version meanwhile."""
        base = self._version() if base is None else base
        now = self.current(base)
        for name, df in changed.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            now[name] = path
        tmp = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(tmp)
        stream.write(bytearray("".join(f"{k}\t{v}\n" for k, v in sorted(now.items())).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(tmp, self._path(f"{self.root}/_versions/{base + 1:010d}"), none)
        except Py4JJavaError as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise RuntimeError("another writer committed first") from e
            raise
        return now

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict[str, str]:
        base = self._version()
        return self.commit(change({n: self.spark.read.parquet(p) for n, p in self.current(base).items()}), base)


def append_only(df: DataFrame, path: str) -> None:
    """Logs are only ever appended to."""
    df.write.mode("append").parquet(path)

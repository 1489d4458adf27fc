"""Listings of sources: what documents there are, without their content. The content of changed documents alone is read
afterwards, by fetch_changed()."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from passagework.functions import text as tx
from passagework.workspace import materialise

LISTING = "source string, source_uri string, title string, source_type string, revision string, access_groups array<string>, department string, doc_type string, classification string, size long, content_path string"


class ListingError(ValueError):
    pass


def checked(listing: DataFrame) -> DataFrame:
    """A listing whose rows all name at least one group and a place to read from; other rows stop the query."""
    ok = (F.coalesce(F.size("access_groups"), F.lit(0)) > 0) & F.col("content_path").isNotNull()
    return listing.where(F.assert_true(ok, F.concat(F.lit("no access group or no content: "), F.coalesce("source_uri", F.lit("?")))).isNull())


# --- manifest of a folder -----------------------------------------------------------------------------------------------

_EXTENSIONS = {"markdown": (".md", ".markdown"), "txt": (".txt", ".text"), "pdf": (".pdf",), "docx": (".docx",)}
_CLASSES, _STATES = {"public", "internal", "confidential", "restricted"}, {"active", "superseded", "deleted"}


def check_manifest(manifest: dict) -> dict:
    """The manifest with defaults filled in. Unknown fields, absolute paths, repeats, extensions that contradict the type
    and groups that are not declared are errors."""
    allowed = {"path", "title", "source_type", "department", "doc_type", "owner", "classification", "access_groups", "effective_date", "source_updated_at", "status", "metadata"}
    groups, seen, docs = set(manifest.get("groups", ())), set(), []
    if extra := set(manifest) - {"version", "company", "description", "groups", "documents"}:
        raise ListingError(f"unknown fields: {sorted(extra)}")
    for d in manifest.get("documents", ()):
        path = d.get("path", "")
        if extra := set(d) - allowed:
            raise ListingError(f"{path}: unknown fields {sorted(extra)}")
        if not path or path.startswith("/") or ".." in Path(path).parts:
            raise ListingError(f"path must be relative: {path!r}")
        if path in seen:
            raise ListingError(f"listed twice: {path}")
        seen.add(path)
        kind = d.get("source_type")
        if kind in _EXTENSIONS and not path.lower().endswith(_EXTENSIONS[kind]):
            raise ListingError(f"{path} is not {kind}")
        own = list(dict.fromkeys(d.get("access_groups", ())))
        if not own or set(own) - groups:
            raise ListingError(f"{path}: groups {sorted(set(own) - groups) or 'missing'}")
        if d.get("classification", "internal") not in _CLASSES or d.get("status", "active") not in _STATES:
            raise ListingError(f"{path}: classification or status unknown")
        docs.append({"classification": "internal", "status": "active"} | d | {"access_groups": own})
    return manifest | {"documents": docs}


def load_manifest(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ListingError("reading YAML needs the yaml module; JSON needs none") from e
        return check_manifest(yaml.safe_load(text))
    return check_manifest(json.loads(text))


def folder_listing(spark: SparkSession, folder: str, manifest: dict, name: str = "local-corpus") -> DataFrame:
    """The manifest joined with the files that are there. The revision is modification time and length; contents are
    not read. A listed file that is missing stops the query."""
    rows = [(d["path"], d.get("title"), d.get("source_type"), d["access_groups"], d.get("department"), d.get("doc_type"), d["classification"]) for d in manifest["documents"] if d["status"] == "active"]
    wanted = spark.createDataFrame(rows, "source_uri string, title string, kind string, access_groups array<string>, department string, doc_type string, classification string")
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    files = files.withColumn("source_uri", F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1]) + "/", ""))
    both = wanted.join(files, "source_uri", "left").where(F.assert_true(F.col("path").isNotNull(), F.concat(F.lit("listed but missing: "), "source_uri")).isNull())
    title = F.coalesce("title", tx.title_from_path(F.col("source_uri")))
    return both.select(F.lit(name).alias("source"), "source_uri", title.alias("title"), F.coalesce("kind", tx.source_type(F.col("source_uri"))).alias("source_type"), F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("revision"), "access_groups", "department", "doc_type", "classification", F.col("length").alias("size"), F.col("path").alias("content_path"))


def missing_files(spark: SparkSession, folder: str, manifest: dict) -> list[str]:
    return sorted(d["path"] for d in manifest["documents"] if not (Path(folder) / d["path"]).exists())


# --- repository host ----------------------------------------------------------------------------------------------------

Transport = Callable[[str], dict]


def recorded_transport(path: str) -> Transport:
    """Answers from a JSON file that maps request paths to bodies."""
    answers = json.loads(Path(path).read_text(encoding="utf-8"))

    def get(request: str) -> dict:
        if request not in answers:
            raise ListingError(f"not found: {request}")
        return answers[request]

    return get


class RepositoryTree(DataSource):
    """Files of a repository as a listing: `spark.read.format("repository_tree")` with the options repo, branch,
    recording (a file of recorded answers), groups (comma list), include (comma list of path prefixes), max_bytes.
    Two requests whatever the number of files; the revision is the file's object id."""

    @classmethod
    def name(cls) -> str:
        return "repository_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        get, repo = recorded_transport(self.o["recording"]), self.o["repo"]
        branch = self.o.get("branch") or get(f"/repos/{repo}")["default_branch"]
        tree = get(f"/repos/{repo}/git/trees/{branch}?recursive=1")
        if tree.get("truncated"):  # what is not listed would be taken for removed
            raise ListingError(f"{repo}: the tree is cut short; list its folders one by one")
        include = tuple(p for p in self.o.get("include", "").split(",") if p)
        groups, most = [g for g in self.o["groups"].split(",") if g], int(self.o.get("max_bytes", 1_000_000))
        if not groups:
            raise ListingError("a repository needs access groups")
        for e in tree["tree"]:
            path = e["path"]
            kind = next((k for k, ends in _EXTENSIONS.items() if path.lower().endswith(ends)), None)
            if e["type"] == "blob" and kind and e.get("size", 0) <= most and (not include or path.startswith(include)):
                stem = Path(path).stem
                title = Path(path).parent.name if stem.lower() == "readme" and Path(path).parent.name else stem
                yield (f"github:{repo}", path, re.sub(r"[-_ ]+", " ", title).strip().title(), kind, e["sha"], groups, None, "documentation", "internal", e.get("size", 0), f"/repos/{repo}/git/blobs/{e['sha']}")


def decode_blob(answer: dict) -> bytes:
    return base64.b64decode(answer["content"]) if answer.get("encoding") == "base64" else answer["content"].encode()


#: Paths named to one read.
PATH_BLOCK = 10_000


def fetch_changed(spark: SparkSession, listing: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """source_uri, source_type, content of the files below `folder` that a sync plan wants read. Only their paths reach the
    driver, in blocks, and only these files are opened."""
    wanted = listing.join(plan.where(F.col("status").isin("ingested", "updated")).select("source", "source_uri"), ["source", "source_uri"], "left_semi").select("source_uri", "source_type", F.col("content_path").alias("path"))
    wanted, out, block = materialise(wanted, "wanted-files"), None, []

    def opened(paths: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load(paths).select("path", "content")

    for row in wanted.select("path").distinct().toLocalIterator():
        block.append(re.sub(r"([{}\[\]*?\\])", r"\\\1", row.path))  # names are no patterns
        if len(block) == PATH_BLOCK:
            out, block = opened(block) if out is None else out.unionByName(opened(block)), []
    if block:
        out = opened(block) if out is None else out.unionByName(opened(block))
    if out is None:
        return wanted.select("source_uri", "source_type", F.lit(None).cast("binary").alias("content")).limit(0)
    return wanted.join(out, "path").select("source_uri", "source_type", "content")

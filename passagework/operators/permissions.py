"""Changing who may see a document or belongs to a group: permissions, the chunks' access lists and the audit row move
together, in one version of the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from passagework.operators.sync import project_acl
from passagework.sources.versions import VersionedTables

AUDIT = "changed_at timestamp, actor string, action string, target string, before array<string>, after array<string>"


class UnknownGroup(ValueError):
    pass


def clean_names(names: list[str]) -> list[str]:
    return list(dict.fromkeys(n for n in (x.strip() for x in names) if n))


def _ids(tables: VersionedTables, names: list[str]) -> dict[str, int]:
    known = {r.group_name: r.group_id for r in tables.table("groups").where(F.col("group_name").isin(names)).collect()}
    if missing := [n for n in names if n not in known]:
        raise UnknownGroup(f"unknown groups: {', '.join(missing)}")
    return known


def set_document_groups(tables: VersionedTables, doc_id: int, names: list[str], actor: str, now: dt.datetime) -> None:
    """Replaces a document's groups. Tables: groups, documents (not read), permissions, chunks, audit."""
    names = clean_names(names)
    if not names:
        raise ValueError("a document needs at least one group")
    ids = _ids(tables, names)
    spark, now_at = tables.spark, now

    def change(t):
        before = sorted(r[0] for r in t["permissions"].where(F.col("doc_id") == doc_id).join(t["groups"], "group_id").select("group_name").collect())
        mine = spark.createDataFrame([(doc_id, i) for i in ids.values()], t["permissions"].select("doc_id", "group_id").schema)
        permissions = t["permissions"].where(F.col("doc_id") != doc_id).select("doc_id", "group_id").unionByName(mine)
        row = spark.createDataFrame([(now_at, actor, "document_groups", str(doc_id), before, sorted(names))], AUDIT)
        acl = F.when(F.col("doc_id") == doc_id, F.array(*(F.lit(i).cast("int") for i in sorted(ids.values())))).otherwise(F.col("access_group_ids"))
        return {"permissions": permissions, "chunks": t["chunks"].withColumn("access_group_ids", acl), "audit": t["audit"].unionByName(row)}

    tables.update(change)


def set_user_groups(tables: VersionedTables, user_id: int, names: list[str], actor: str, now: dt.datetime) -> None:
    """Replaces a user's groups; none is allowed and takes effect with the next read."""
    names = clean_names(names)
    ids = _ids(tables, names) if names else {}
    spark = tables.spark

    def change(t):
        own = t["users"].where(F.col("user_id") == user_id).first()
        if own is None:
            raise ValueError(f"no user {user_id}")
        labels = {r.group_id: r.group_name for r in t["groups"].where(F.col("group_id").isin(list(own.group_ids))).collect()} if own.group_ids else {}
        groups = F.array(*(F.lit(i).cast("int") for i in sorted(ids.values()))) if ids else F.array().cast("array<int>")
        row = spark.createDataFrame([(now, actor, "user_groups", str(user_id), sorted(labels.values()), sorted(names))], AUDIT)
        return {"users": t["users"].withColumn("group_ids", F.when(F.col("user_id") == user_id, groups).otherwise(F.col("group_ids"))), "audit": t["audit"].unionByName(row)}

    tables.update(change)


def rebuild_acl(tables: VersionedTables) -> None:
    tables.update(lambda t: {"chunks": project_acl(t["chunks"], t["permissions"])})

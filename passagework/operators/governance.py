"""Identities, permissions, audit, spend and constraints."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import access as ac


def identities(users: DataFrame, groups: DataFrame) -> DataFrame:
    """user_id, email, group_names: sorted names of a user's groups; users without groups stay."""
    named = users.select("user_id", F.explode("group_ids").alias("group_id")).distinct().join(groups, "group_id")
    lists = named.groupBy("user_id").agg(F.sort_array(F.collect_set("group_name")).alias("group_names"))
    return users.select("user_id", "email", "user_role").join(lists, "user_id", "left").withColumn("group_names", F.coalesce("group_names", F.array().cast("array<string>")))


def resolve_groups(names: DataFrame, groups: DataFrame, key: str, column: str) -> DataFrame:
    """key, group_ids in the order given, unknown: names are trimmed, blanks and repeats dropped."""
    clean = F.array_distinct(F.filter(F.transform(F.col(column), lambda x: F.trim(x)), lambda n: n != ""))
    each = names.select(key, F.posexplode_outer(clean).alias("pos", "group_name")).join(groups.select("group_name", "group_id"), "group_name", "left")
    known = F.transform(F.array_sort(F.collect_list(F.when(F.col("group_id").isNotNull(), F.struct("pos", "group_id")))), lambda s: s["group_id"])
    unknown = F.array_sort(F.collect_list(F.when(F.col("group_id").isNull(), F.col("group_name"))))
    return each.groupBy(key).agg(known.alias("group_ids"), unknown.alias("unknown"))


def require_known(resolved: DataFrame) -> DataFrame:
    """The same rows; a row with an unknown name stops the query."""
    return resolved.where(F.assert_true(F.size("unknown") == 0, F.concat(F.lit("unknown groups: "), F.array_join("unknown", ", "))).isNull())


def document_acl(chunks: DataFrame) -> DataFrame:
    """doc_id, access_group_ids: what a document's chunks carry."""
    each = chunks.select("doc_id", F.explode("access_group_ids").alias("g")).distinct()
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_set("g")).alias("access_group_ids"))


def visible_counts(callers: DataFrame, chunks: DataFrame) -> DataFrame:
    """user_id, n_visible. Chunks are counted per distinct access list before anything is joined."""
    per_list = chunks.groupBy(ac.set_key("access_group_ids").alias("acl_set")).agg(F.count(F.lit(1)).alias("n"))
    sets = ac.visible_sets(callers, chunks)
    per_caller = sets.join(per_list, "acl_set").groupBy("caller_set").agg(F.sum("n").alias("n_visible"))
    keyed = callers.select("user_id", ac.set_key("group_ids").alias("caller_set"))
    return keyed.join(per_caller, "caller_set", "left").select("user_id", F.coalesce("n_visible", F.lit(0)).cast("long").alias("n_visible"))


def latest_delivery(events: DataFrame, key: str, arrived: str) -> DataFrame:
    """Rows delivered twice under one key become the first to be logged."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min(F.struct(arrived, *[c for c in cols if c != arrived])).alias("r")).select(key, "r.*")


def document_access(events: DataFrame, users: DataFrame, since: dt.datetime | Column) -> DataFrame:
    """Accesses at or after a moment with the user's present name; unknown users stay."""
    s = since if isinstance(since, Column) else F.lit(since)
    return events.where(F.col("created_at") >= s).join(users.select("user_id", "display_name", "user_role"), "user_id", "left")


def backfill_documents(events: DataFrame) -> DataFrame:
    """request_id, doc_ids: the distinct documents of every request."""
    return events.where("doc_id is not null").groupBy("request_id").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def spend_by_day(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(F.to_date("created_at").alias("day")).agg(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast("decimal(18,6)").alias("spent"), F.count(F.lit(1)).alias("n_requests"))


def spent_since_midnight(outcomes: DataFrame, now: Column) -> DataFrame:
    """spent: one row, 0 without requests. now is a moment; days begin at 00:00 UTC."""
    day = F.date_trunc("day", now)
    return outcomes.where((F.col("created_at") >= day) & (F.col("created_at") <= now)).agg(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast("decimal(18,6)").alias("spent"))


def budget_exhausted(outcomes: DataFrame, budget: float | None) -> DataFrame:
    """outcome_id, refused: whether what was spent that day before the request had reached the budget; no budget refuses
    nothing. Ties in time are taken in the order of their ids."""
    if budget is None:
        return outcomes.select("outcome_id", F.lit(False).alias("refused"))
    # a day is cut into minutes: one row per minute carries what the day had spent before it, so no task holds a day
    minute = F.date_trunc("minute", F.col("created_at"))
    rows = outcomes.select("outcome_id", "created_at", "estimated_cost_usd", F.to_date("created_at").alias("day"), minute.alias("minute"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("day", "minute").agg(F.sum("estimated_cost_usd").alias("cost"))
    per = per.select("minute", F.coalesce(F.sum("cost").over(earlier("day").orderBy("minute")), F.lit(0)).alias("day_before"))
    within = F.coalesce(F.sum("estimated_cost_usd").over(earlier("minute").orderBy("created_at", "outcome_id")), F.lit(0))
    each = rows.withColumn("within", within).join(per, "minute", "left")
    return each.select("outcome_id", (F.coalesce("day_before", F.lit(0)) + F.col("within") >= F.lit(budget)).alias("refused"))


def membership_changes(current: DataFrame, desired: DataFrame) -> DataFrame:
    """user_id, group_id, action: what turns the current memberships into the desired ones."""
    add = desired.join(current, ["user_id", "group_id"], "left_anti").withColumn("action", F.lit("add"))
    drop = current.join(desired, ["user_id", "group_id"], "left_anti").withColumn("action", F.lit("remove"))
    return add.unionByName(drop)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule. A rule that is null is kept."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules)))
    return counts.select(pairs.alias("p")).select("p.rule", "p.n")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once; the counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

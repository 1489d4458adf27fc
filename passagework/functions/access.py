"""Who may see what. `scoped` is the only way from chunks to candidates, and it applies the access predicate below every
ranking; `recheck` looks again at what comes out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    departments: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    classifications: tuple[str, ...] = ()
    updated_after: dt.date | None = None
    updated_before: dt.date | None = None

    @property
    def is_empty(self) -> bool:
        return self == Filters()

    def describe(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if v}


@dataclass(frozen=True)
class Request:
    """One caller's request. Groups have no default: forgetting them must fail."""

    text: str
    group_ids: tuple[int, ...]
    limit: int = 50
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self):
        if not isinstance(self.group_ids, tuple):
            raise TypeError("group_ids must be a tuple")
        if self.limit < 1:
            raise ValueError("limit must be at least 1")

    @property
    def sees_nothing(self) -> bool:
        return not self.group_ids


def may_see(acl: Column, groups: tuple[int, ...] | list[int] | Column) -> Column:
    """Whether a list of groups meets the access list; an empty list sees nothing."""
    if isinstance(groups, Column):
        return F.coalesce(F.arrays_overlap(F.filter(acl, lambda g: g.isNotNull()), F.filter(groups, lambda g: g.isNotNull())), F.lit(False))
    return F.coalesce(F.arrays_overlap(F.filter(acl, lambda g: g.isNotNull()), F.array(*map(F.lit, groups))), F.lit(False)) if groups else F.lit(False)


def metadata_predicate(f: Filters) -> Column:
    """A null never passes a filter; both dates are bounds at midnight UTC, inclusive."""
    out = F.lit(True)
    for column, wanted in (("department", f.departments), ("doc_type", f.doc_types), ("classification", f.classifications)):
        if wanted:
            out &= F.col(column).isin(*wanted)
    if f.updated_after:
        out &= F.col("source_updated_at") >= F.lit(f.updated_after).cast("timestamp")
    if f.updated_before:
        out &= F.col("source_updated_at") <= F.lit(f.updated_before).cast("timestamp")
    return out


def scoped(chunks: DataFrame, request: Request) -> DataFrame:
    return chunks.where(may_see(F.col("access_group_ids"), request.group_ids) & metadata_predicate(request.filters))


def recheck(candidates: DataFrame, groups: Column | tuple[int, ...], acl: str = "access_group_ids") -> tuple[DataFrame, DataFrame]:
    """(kept, violations): what an index handed out although the caller may not see it."""
    ok = may_see(F.col(acl), groups)
    return candidates.where(ok), candidates.where(~ok)


def visible_sets(callers: DataFrame, acls: DataFrame) -> DataFrame:
    """caller_set, acl_set: which distinct group lists meet which distinct access lists. Both sides are reduced to their
    distinct lists first, and joined on single groups, so no pair of rows is ever compared."""
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    u = callers.select(F.col("group_ids").alias("g")).distinct().select(key(F.col("g")).alias("caller_set"), F.explode("g").alias("group_id")).distinct()
    c = acls.select(F.col("access_group_ids").alias("g")).distinct().select(key(F.col("g")).alias("acl_set"), F.explode("g").alias("group_id")).distinct()
    return u.join(c, "group_id").select("caller_set", "acl_set").distinct()


def set_key(column: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.col(column))), ",")

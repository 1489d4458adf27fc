"""Retrieval quality and run summaries as aggregates over tables of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)
#: The categories of held-out cases.
CATEGORIES = ("factoid", "multi_hop", "permission_negative", "unanswerable")


def document_ranking(hits: DataFrame, limit: int = 10) -> DataFrame:
    """hits: request_id, position, source_uri. Each document at its first place, ranked anew."""
    first = hits.groupBy("request_id", "source_uri").agg(F.min("position").alias("p"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("p", "source_uri"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("request_id", "source_uri", "rank")


def _per_case(cases: DataFrame, ranking: DataFrame) -> DataFrame:
    """request_id, relevant (distinct), retrieved in order."""
    lists = ranking.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_uri"))).alias("s")).select("request_id", F.transform("s", lambda s: s["source_uri"]).alias("retrieved"))
    empty = F.array().cast("array<string>")
    return cases.join(lists, "request_id", "left").withColumn("retrieved", F.coalesce("retrieved", empty)).withColumn("relevant", F.array_distinct(F.coalesce("expected_sources", empty)))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.size(relevant)).otherwise(0.0)


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.lit(k) if k > 0 else F.lit(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    hits = F.filter(F.transform(retrieved, lambda u, i: F.when(F.array_contains(relevant, u), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(hits) > 0, 1 / F.array_min(hits)).otherwise(0.0)


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    gain = lambda i: 1 / F.log2(i.cast("double") + 2)
    dcg = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda u, i: F.when(F.array_contains(relevant, u), gain(i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.lit(k), F.size(relevant)) - 1, F.lit(0))), gain), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(relevant) > 0, dcg / ideal).otherwise(0.0)


def case_metrics(cases: DataFrame, ranking: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """request_id, k, recall, precision, ndcg, rr of every case and cut, in 4 places."""
    per = _per_case(cases, ranking)
    got, rel = F.col("retrieved"), F.col("relevant")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(recall_at(got, rel, k), 4).alias("recall"), F.round(precision_at(got, rel, k), 4).alias("precision"), F.round(ndcg_at(got, rel, k), 4).alias("ndcg")) for k in cuts)))
    return per.select("request_id", F.round(reciprocal_rank(got, rel), 4).alias("rr"), rows.alias("m")).select("request_id", "m.*", "rr")


def retrieval_summary(cases: DataFrame, ranking: DataFrame) -> DataFrame:
    """k, mean recall, precision and ndcg and mean reciprocal rank over the cases that have expected sources."""
    m = case_metrics(cases.where(F.size("expected_sources") > 0), ranking)
    # means of ten-thousandths, rounded half up over integers: the same in every engine
    mean = lambda c: F.floor(F.sum(F.round(F.col(c) * 10_000).cast("long")) / F.count(F.lit(1)) + 0.5) / 10_000
    return m.groupBy("k").agg(*(mean(c).alias(c) for c in ("recall", "precision", "ndcg")), mean("rr").alias("mrr"), F.count(F.lit(1)).alias("n_cases"))


def leaks(cases: DataFrame, ranking: DataFrame) -> DataFrame:
    """request_id, leaked: forbidden sources that were retrieved."""
    per = _per_case(cases, ranking)
    return per.select("request_id", F.array_sort(F.array_intersect("retrieved", F.coalesce("forbidden_sources", F.array().cast("array<string>")))).alias("leaked")).where(F.size("leaked") > 0)


def fact_coverage(answer: Column, facts: Column) -> Column:
    """Part of the facts of which an alternative ('a|b') stands in the answer; without facts 1."""
    plain = F.lower(F.trim(F.regexp_replace(answer, r"\s+", " ")))
    options = lambda f: F.filter(F.transform(F.split(f, r"\|"), lambda a: F.trim(F.lower(F.regexp_replace(a, r"\s+", " ")))), lambda a: a != "")
    found = F.filter(facts, lambda f: F.exists(options(f), lambda a: plain.contains(a)))
    return F.when(F.size(facts) > 0, F.size(found) / F.size(facts)).otherwise(1.0)


def citation_precision(cited: Column, relevant: Column) -> Column:
    c = F.array_distinct(cited)
    return F.when(F.size(c) > 0, F.size(F.array_intersect(c, relevant)) / F.size(c)).otherwise(0.0)


def nearest_rank(column: str, p: float) -> Column:
    """The ceil(p n)-th smallest value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: request_id, rr, ranking (one string). Counts over the cases both runs have."""
    b, a = before.select("request_id", F.col("rr").alias("rr0"), F.col("ranking").alias("r0")), after.select("request_id", F.col("rr").alias("rr1"), F.col("ranking").alias("r1"))
    d = F.col("rr1") - F.col("rr0")
    return b.join(a, "request_id").agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("r0") != F.col("r1")).alias("n_reordered"), F.count_if(d >= 5e-4).alias("n_improved"), F.count_if(d <= -5e-4).alias("n_regressed"))


def report_text(summary: list[dict]) -> str:
    """A fixed-width table of summary rows."""
    if not summary:
        return "no cases\n"
    cols = list(summary[0])
    lines = ["  ".join(f"{c:>10}" for c in cols)] + ["  ".join(f"{r[c]:>10.4f}" if isinstance(r[c], float) else f"{r[c]!s:>10}" for c in cols) for r in summary]
    return "\n".join(lines) + "\n"


def save_report(summary: list[dict], folder: str, label: str) -> str:
    """The summary as JSON beside earlier ones; returns the path."""
    import json
    from pathlib import Path

    path = Path(folder) / f"{label}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps([json_safe(r) for r in summary], indent=1), encoding="utf-8")
    return str(path)


def json_safe(value):
    """Dates as ISO text, sets and tuples as lists, paths as text, whatever the nesting."""
    import datetime as dt
    from decimal import Decimal
    from pathlib import PurePath

    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        items = [json_safe(v) for v in value]
        return sorted(items, key=str) if isinstance(value, (set, frozenset)) else items
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else str(value) if isinstance(value, PurePath) else value

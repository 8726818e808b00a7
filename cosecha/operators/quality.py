"""Data-quality reports: coverage, errors, snapshots and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.columns import first_per_key

# Error kinds and message parts that a retry usually cures, or that mean a repeat.
TRANSIENT_KINDS = ["upload_transient", "upload_duplicate", "database_error", "processing_failed"]
TRANSIENT_PARTS = [
    "errno 35", "resource temporarily unavailable", "rate limit", "too many requests", "connection reset", "connection refused",
    "timeout", "network connection lost", "gateway error", "already processed", "already exists", "duplicate",
]


def working_days(dates: DataFrame, column: str, holidays: list[str] = ()) -> DataFrame:
    """Every Monday to Saturday between the first and the last date, without holidays; one row in, a calendar out."""
    bounds = dates.agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a is not null")
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 6)
    return days.filter(~F.col("day").cast("string").isin(list(holidays))) if holidays else days


def coverage(dates: DataFrame, column: str) -> DataFrame:
    """By month: expected and present days, those missing and those that were not expected."""
    present = dates.select(F.col(column).alias("day")).filter("day is not null").distinct().withColumn("present", F.lit(1))
    expected = working_days(dates, column).withColumn("expected", F.lit(1))
    both = expected.join(present, "day", "full")
    month = F.date_format("day", "yyyy-MM")
    count = lambda condition: F.count(F.when(condition, 1))
    e, p = F.col("expected").isNotNull(), F.col("present").isNotNull()
    return both.groupBy(month.alias("month")).agg(count(e).alias("expected"), count(e & p).alias("present"), count(e & ~p).alias("missing"), count(~e & p).alias("unexpected"))


def transient(kind: Column, message: Column) -> Column:
    """Whether an error is of a transient kind or its message has a transient part, whatever the case."""
    parts = F.lit(False)
    for part in TRANSIENT_PARTS:
        parts = parts | F.lower(F.coalesce(message, F.lit(""))).contains(part)
    return F.coalesce(kind, F.lit("")).isin(TRANSIENT_KINDS) | parts


def lasting_errors(errors: DataFrame, done: DataFrame, per_type: int = 50) -> DataFrame:
    """As ``error_report`` without transient errors, with the place of each type by its size, the largest first."""
    report = error_report(errors.filter(~transient(F.col("error_type"), F.col("message"))), done, per_type)
    types = report.select("error_type", "errors").distinct()
    # One row for each type of error.
    ranks = types.withColumn("type_place", F.row_number().over(Window.orderBy(F.desc("errors"), "error_type"))).select("error_type", "type_place")
    return report.join(ranks, "error_type")


def error_report(errors: DataFrame, done: DataFrame, per_type: int = 50) -> DataFrame:
    """Unresolved errors whose source was not processed since, the latest of each type, with the type's size."""
    open_ = errors.filter(~F.col("resolved")).join(done.select("source").distinct(), "source", "left_anti")
    sizes = open_.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
    place = F.row_number().over(Window.partitionBy("error_type").orderBy(F.desc("created_at"), F.desc("error_id")))
    return open_.withColumn("place", place).filter(F.col("place") <= per_type).join(sizes, "error_type").select("error_type", "errors", "place", "error_id", "source")


def new_since(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` whose key ``before`` lacks."""
    return after.join(before.select(key), key, "left_anti")


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    missing = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def latencies(events: DataFrame, group: str, value: str) -> DataFrame:
    """Count, extremes and interpolated percentiles to six decimals, which engines interpolate in different order.

    Equal values are counted before they are shuffled again; a group's distinct values meet in one task.
    """
    at = lambda p: F.round(F.percentile(value, F.lit(p), F.col("rows")), 6)
    counts = events.groupBy(group, value).agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy(group).agg(F.sum(F.when(F.col(value).isNotNull(), F.col("rows")).otherwise(0)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def without_duplicates(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return first_per_key(rows, keys, *order)


def reference_counts(members: DataFrame, facts: dict[str, DataFrame], key: str) -> DataFrame:
    """How often each member is used in every fact, and in all."""
    out = members.select(key)
    for name, rows in facts.items():
        out = out.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("uses", sum((F.col(n) for n in facts), F.lit(0)))

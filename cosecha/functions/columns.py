"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_ORIGIN = "Desconocido"


def trailing(column: str, as_of: str, days: int) -> Column:
    """Within ``days`` before ``as_of``, the first day included and no upper bound; 0 or fewer days mean all since 1900."""
    start = F.date_sub(F.lit(as_of).cast("date"), days) if days > 0 else F.lit("1900-01-01").cast("date")
    return F.col(column) >= start


def optional(df: DataFrame, **equals: object) -> DataFrame:
    """``df`` filtered on every column whose wanted value is neither None nor empty."""
    for name, value in equals.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    return df


def with_origin(df: DataFrame, origin: str | None) -> DataFrame:
    """Rows of one origin; a missing origin compares as the empty text, and an empty wish means all."""
    return df.filter(F.coalesce("origin", F.lit("")) == origin) if origin else df


def known_origin() -> Column:
    """The origin, or a label where it is missing or empty."""
    return F.coalesce(F.nullif("origin", F.lit("")), F.lit(UNKNOWN_ORIGIN))


def twice_effective() -> Column:
    """Twice the effective price: the mean, else the middle of both bounds. Doubled, it needs no division."""
    return F.coalesce(F.col("avg_price") + F.col("avg_price"), F.col("min_price") + F.col("max_price"))


def mean_of_twice(column: str) -> Column:
    """The mean of a column that holds doubled decimals: one exact sum, divided at the end."""
    return F.sum(column).cast("double") / F.nullif(F.count(column) * 2, F.lit(0))


def exact_mean(column: str) -> Column:
    """The mean of a decimal column: one exact sum, divided at the end; null over no value."""
    return F.sum(column).cast("double") / F.nullif(F.count(column), F.lit(0))


def first_positive(*names: str) -> Column:
    """The first of ``names`` that is neither null nor 0, else 0."""
    return F.coalesce(*(F.when(F.col(n) != 0, F.col(n)) for n in names), F.lit(0).cast("decimal(14,2)"))


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key (null keys group together) in ``order``, which must break all ties that matter."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def percent_change(old: Column, new: Column) -> Column:
    """(new - old) / old in percent; 0 where old is 0."""
    return F.when(old == 0, F.lit(0.0)).otherwise((new - old) / old * 100)


def text(column: str) -> Column:
    """A date or id as text, under its own name."""
    return F.col(column).cast("string").alias(column)

"""Row feeds and small summaries behind lists, filters and chips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosecha.functions.columns import exact_mean, first_per_key, first_positive, optional, text, trailing
from cosecha.operators.prices import newest_first

_MONEY = ("min_price", "max_price", "avg_price")


def price_series(prices: DataFrame, markets: DataFrame, as_of: str, days: int = 30, limit: int | None = None, **equals: object) -> DataFrame:
    """A product's price lines with market names, newest first; a line without a market stays."""
    rows = optional(prices.filter(trailing("price_date", as_of, days)), **equals)
    named = rows.join(markets.select("market_id", "market_name"), "market_id", "left")
    named = named.orderBy(*newest_first()).limit(limit) if limit is not None else named
    return named.select("product_id", "market_name", "presentation_id", "units_id", text("price_date"), "round", *(F.col(c).cast("double").alias(c) for c in _MONEY))


def scoped(prices: DataFrame, scope: str, market: int | None) -> DataFrame:
    """Rows of the default market under the scope 'mercado'; every other scope means all rows."""
    return optional(prices, market_id=market) if scope == "mercado" else prices


def market_products(prices: DataFrame, products: DataFrame, market: int, as_of: str, days: int = 14) -> DataFrame:
    """Products with a price at a market, how many lines each has, and its newest day."""
    rows = optional(prices.filter(trailing("price_date", as_of, days)), market_id=market)
    per = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("lines"), F.max("price_date").alias("price_date"))
    return per.join(products.select("product_id", "product_name", "category_name"), "product_id").select("product_id", "product_name", "category_name", "lines", text("price_date"))


def supply_rows(supply: DataFrame, as_of: str, days: int, **equals: object) -> DataFrame:
    """Arrivals in a window, all of them."""
    rows = optional(supply.filter(trailing("observation_date", as_of, days)), **equals)
    return rows.select(text("observation_date"), "product_id", "city_id", "origin", F.col("quantity_kg").cast("double").alias("quantity_kg"))


def common_presentation(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """Of each product the presentation with most lines, the one seen last on ties, then the smaller name."""
    counts = prices.filter(trailing("price_date", as_of, days)).groupBy("product_id", "presentation_id").agg(F.count(F.lit(1)).alias("lines"), F.max("price_date").alias("newest"))
    return first_per_key(counts, ["product_id"], F.desc("lines"), F.desc("newest"), F.asc("presentation_id")).select("product_id", "presentation_id", "lines")


def filter_inputs(inputs: DataFrame, departments: Sequence[int] = (), subgroups: Sequence[str] = (), presentations: Sequence[str] = (), codes: Sequence[str] = ()) -> DataFrame:
    """Input prices by four independent selections; an empty selection means all."""
    for name, wanted in (("department_id", departments), ("subgroup", subgroups), ("presentation", presentations), ("cpc_code", codes)):
        inputs = inputs.filter(F.col(name).isin(list(wanted))) if wanted else inputs
    means = inputs.groupBy("input_id", "department_id", "presentation").agg(exact_mean("avg_price").alias("mean_price"), F.count(F.lit(1)).alias("lines"))
    return means.orderBy(F.coalesce("mean_price", F.lit(0.0)), "input_id", "department_id", "presentation")


def filter_values(prices: DataFrame) -> DataFrame:
    """The distinct presentations and units of each product, sorted, as chips."""
    chips = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    return prices.groupBy("product_id").agg(chips("presentation_id").alias("presentations"), chips("units_id").alias("units"))


def spark_signs(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """Whether each product's newest price is at least its oldest, and whether all its prices fall on one day."""
    rows = prices.filter(trailing("price_date", as_of, days)).withColumn("price", first_positive("avg_price", "max_price", "min_price")).filter("price > 0")
    age = F.struct("price_date", "round", "order_id", "line", "price")
    ends = rows.groupBy("product_id").agg(F.min(age).alias("a"), F.max(age).alias("b"))
    return ends.select("product_id", (F.col("b.price") >= F.col("a.price")).cast("int").alias("rising"), (F.col("a.price_date") == F.col("b.price_date")).cast("int").alias("one_day"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not empty, in order."""
    return rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct().orderBy(column)


def find_errors(errors: DataFrame, kind: str | None = None, resolved: bool | None = None, since: str | None = None, until: str | None = None, contains: str | None = None) -> DataFrame:
    """Errors by optional kind, state, time range and part of the message whatever its case."""
    rows = optional(errors, error_type=kind)
    rows = rows if resolved is None else rows.filter(F.col("resolved") == resolved)
    rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) if since else rows
    rows = rows.filter(F.col("created_at") <= F.lit(until).cast("timestamp_ntz")) if until else rows
    return rows.filter(F.lower("message").contains(contains.lower())) if contains else rows

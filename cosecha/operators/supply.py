"""Supply analytics: totals, rankings and averages of arrivals at markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosecha.functions.columns import known_origin, optional, text, trailing, with_origin


def _window(supply: DataFrame, as_of: str, days: int, origin: str | None = None, **equals: object) -> DataFrame:
    return with_origin(optional(supply.filter(trailing("observation_date", as_of, days)), **equals), origin)


def summary(supply: DataFrame, as_of: str, days: int, origin: str | None = None, **equals: object) -> DataFrame:
    """One row, also over nothing: total, mean per reporting day, reporting days, oldest and newest day."""
    total = F.coalesce(F.sum("quantity_kg").cast("double"), F.lit(0.0))
    dates = F.countDistinct("observation_date")
    out = _window(supply, as_of, days, origin, **equals).agg(total.alias("total_kg"), dates.alias("num_days"), F.min("observation_date").alias("oldest_obs"), F.max("observation_date").alias("newest_obs"))
    daily = F.when(F.col("num_days") > 0, F.col("total_kg") / F.col("num_days")).otherwise(0.0)
    return out.select("total_kg", daily.alias("daily_avg_kg"), "num_days", text("oldest_obs"), text("newest_obs"))


def top(supply: DataFrame, key: str, as_of: str, days: int, limit: int | None, origin: str | None = None, **equals: object) -> DataFrame:
    """``key``, total_kg and newest_obs of the largest totals; ties go to the smaller key."""
    totals = _window(supply, as_of, days, origin, **equals).groupBy(key).agg(F.sum("quantity_kg").alias("total_kg"), F.max("observation_date").alias("newest_obs"))
    if limit is not None:
        totals = totals.orderBy(F.desc_nulls_last("total_kg"), F.asc_nulls_last(key)).limit(limit)
    return totals.select(key, F.col("total_kg").cast("double").alias("total_kg"), text("newest_obs"))


def top_products(supply: DataFrame, products: DataFrame, as_of: str, days: int, limit: int | None = 10, origin: str | None = None, market: int | None = None) -> DataFrame:
    """The most supplied products with their names; the names join after the cut."""
    totals = top(supply, "product_id", as_of, days, limit, origin, market_id=market)
    return totals.join(products.select("product_id", "product_name"), "product_id", "left")


def top_origins(supply: DataFrame, as_of: str, days: int, limit: int | None = 15, **equals: object) -> DataFrame:
    """Origins by total; missing ones under one label."""
    return top(supply.withColumn("origin", known_origin()), "origin", as_of, days, limit, None, **equals).withColumnRenamed("origin", "dept_name")


def top_destinations(supply: DataFrame, markets: DataFrame, as_of: str, days: int, limit: int | None = 15, origin: str | None = None, product: int | None = None) -> DataFrame:
    """Markets by total; arrivals without a market do not count."""
    totals = top(supply.filter("market_id is not null"), "market_id", as_of, days, limit, origin, product_id=product)
    return totals.join(markets.select("market_id", "market_name"), "market_id", "left")


def by_date(supply: DataFrame, as_of: str, days: int, origin: str | None = None, **equals: object) -> DataFrame:
    """Total of each day that has one, in order."""
    daily = _window(supply, as_of, days, origin, **equals).groupBy("observation_date").agg(F.sum("quantity_kg").cast("double").alias("total_kg"))
    return daily.orderBy("observation_date").select(text("observation_date"), "total_kg")


def by_department(supply: DataFrame, cities: DataFrame, as_of: str, days: int = 30, product: int | None = None) -> DataFrame:
    """Total by department of the destination; pre-aggregated by city, so that the join is small."""
    per_city = _window(supply, as_of, days, product_id=product).groupBy("city_id").agg(F.sum("quantity_kg").alias("kg"))
    return per_city.join(cities, "city_id").groupBy("department_id").agg(F.sum("kg").cast("double").alias("total_kg"))


def national_averages(supply: DataFrame, as_of: str, days: int = 30, products: Sequence[int] | None = None) -> DataFrame:
    """Of each product: mean total per market, total and markets; arrivals without a market do not count."""
    rows = _window(supply, as_of, days).filter("market_id is not null")
    if products is not None:
        rows = rows.filter(F.col("product_id").isin(list(products)))
    per_market = rows.groupBy("product_id", "market_id").agg(F.sum("quantity_kg").alias("kg"))
    total = F.sum("kg").cast("double")
    return per_market.groupBy("product_id").agg((total / F.count("kg")).alias("avg_kg_per_market"), total.alias("total_kg"), F.count("kg").alias("market_count"))


def markets_of(rows: DataFrame, date: str, as_of: str, days: int, **equals: object) -> DataFrame:
    """The distinct markets of a product's rows."""
    return optional(rows.filter(trailing(date, as_of, days)), **equals).filter("market_id is not null").select("market_id").distinct()


def compare_markets(supply: DataFrame, products: DataFrame, first: int, second: int, as_of: str, days: int) -> DataFrame:
    """Products that both markets received, with totals and the second's difference in percent of the first."""
    rows = _window(supply, as_of, days).filter(F.col("market_id").isin(first, second))
    kg = lambda market: F.sum(F.when(F.col("market_id") == market, F.col("quantity_kg")))
    both = rows.groupBy("product_id").agg(kg(first).alias("a"), kg(second).alias("b")).filter("a is not null and b is not null")
    difference = F.when(F.col("a") > 0, (F.col("b") - F.col("a")).cast("double") / F.col("a").cast("double") * 100)
    both = both.join(products.select("product_id", "category_name"), "product_id", "left")
    return both.select("product_id", "category_name", F.col("a").cast("double").alias("kg_a"), F.col("b").cast("double").alias("kg_b"), difference.alias("diff_pct"))

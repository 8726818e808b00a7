"""Price analytics: latest prices, national averages, comparisons, movers and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.columns import exact_mean, first_per_key, first_positive, mean_of_twice, optional, text, trailing, twice_effective

SERIES = ["product_id", "presentation_id", "units_id"]
#: Newest first; the line's keys break ties between rounds of a day.
NEWEST = ("price_date", "round", "order_id", "line", "max_price", "min_price")


def newest_first() -> list[Column]:
    return [F.desc_nulls_last(c) for c in NEWEST]


def positive(prices: DataFrame) -> DataFrame:
    """Rows whose first known price (mean, low, high) is above 0."""
    return prices.filter(F.coalesce("avg_price", "min_price", "max_price", F.lit(0).cast("decimal(14,2)")) > 0)


def by_department(prices: DataFrame, cities: DataFrame, as_of: str, days: int = 30, product: int | None = None, presentation: str | None = None, units: str | None = None) -> DataFrame:
    """Mean effective price and number of rows by department; rows without an effective price count, but not in the mean."""
    rows = optional(prices.filter(trailing("price_date", as_of, days)), product_id=product, presentation_id=presentation, units_id=units)
    rows = positive(rows).withColumn("eff2", twice_effective())
    per_city = rows.groupBy("city_id").agg(F.sum("eff2").alias("eff2"), F.count("eff2").alias("known"), F.count(F.lit(1)).alias("n"))
    per = per_city.join(cities, "city_id").groupBy("department_id")
    mean = F.sum("eff2").cast("double") / F.nullif(F.sum("known") * 2, F.lit(0))
    return per.agg(mean.alias("avg_price"), F.sum("n").alias("observation_count"))


def latest_per_market(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """The newest row of each product, presentation, units and market; rows without a market form a group."""
    return first_per_key(prices.filter(trailing("price_date", as_of, days)), [*SERIES, "market_id"], *newest_first())


def national_averages(prices: DataFrame, as_of: str, days: int = 30, products: Sequence[int] | None = None) -> DataFrame:
    """Mean of the markets' latest effective prices, the newest day, and the number of markets (no market counts as one)."""
    rows = prices if products is None else prices.filter(F.col("product_id").isin(list(products)))
    latest = latest_per_market(rows, as_of, days).withColumn("eff2", twice_effective())
    means = latest.groupBy(*SERIES).agg(mean_of_twice("eff2").alias("avg_price"), F.max("price_date").alias("price_date"), F.count(F.lit(1)).alias("market_count"))
    return means.select(*SERIES, "avg_price", text("price_date"), "market_count")


def presentations(prices: DataFrame, product: int, as_of: str, days: int = 30) -> DataFrame:
    """The distinct pairs of presentation and units of a product's positive prices."""
    rows = positive(optional(prices.filter(trailing("price_date", as_of, days)), product_id=product))
    return rows.filter("presentation_id is not null and units_id is not null").select("presentation_id", "units_id").distinct()


def latest_per_product(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """The newest row of each product."""
    newest = first_per_key(prices.filter(trailing("price_date", as_of, days)), ["product_id"], *newest_first())
    return newest.select("product_id", text("market_id"), text("price_date"), *(F.col(c).cast("double").alias(c) for c in ("min_price", "max_price", "avg_price")))


def with_default_market(prices: DataFrame, market: int, as_of: str, days: int) -> DataFrame:
    """The newest row of each product at the default market, else anywhere, with where it comes from."""
    rows = prices.filter(trailing("price_date", as_of, days))
    at_market = first_per_key(rows.filter(F.col("market_id") == market), ["product_id"], *newest_first()).withColumn("scope", F.lit("mercado"))
    others = rows.join(at_market.select("product_id"), "product_id", "left_anti")
    national = first_per_key(others, ["product_id"], *newest_first()).withColumn("scope", F.lit("nacional"))
    return at_market.unionByName(national).select("product_id", "scope", text("price_date"), F.col("max_price").cast("double").alias("max_price"))


def market_ranking(prices: DataFrame, presentation: str, as_of: str, days: int) -> DataFrame:
    """Of each product, median and mean of its markets' latest positive prices in one presentation."""
    rows = prices.filter(F.col("presentation_id") == presentation).filter(trailing("price_date", as_of, days)).filter("market_id is not null")
    latest = first_per_key(rows, ["product_id", "market_id"], *newest_first()).withColumn("price", first_positive("avg_price", "max_price", "min_price")).filter("price > 0")
    # The two middle prices, so that the median is exact.
    place = Window.partitionBy("product_id").orderBy("price", "market_id")
    ranked = latest.withColumns({"at": F.row_number().over(place), "n": F.count(F.lit(1)).over(Window.partitionBy("product_id"))})
    middle = F.when((F.col("at") * 2 >= F.col("n")) & (F.col("at") * 2 <= F.col("n") + 2), F.col("price"))
    return ranked.groupBy("product_id").agg((F.sum(middle).cast("double") / F.count(middle)).alias("median_price"), exact_mean("price").alias("mean_price"), F.count(F.lit(1)).alias("market_count"))


def movers(prices: DataFrame, as_of: str, days: int = 30, limit: int | None = 15, market: int | None = None) -> DataFrame:
    """The largest relative changes from the oldest to the newest price of a series, the best series of each product.

    A price is the first of mean, high and low that is not 0. Series need two rows and a
    positive oldest price.
    """
    rows = optional(prices.filter(trailing("price_date", as_of, days)), market_id=market)
    rows = rows.withColumn("price", first_positive("avg_price", "max_price", "min_price"))
    age = F.struct("price_date", "round", "order_id", "line", "price")
    series = rows.groupBy("product_id", "presentation_id").agg(F.min(age).alias("old"), F.max(age).alias("new"), F.count(F.lit(1)).alias("n"))
    change = (F.col("new.price") - F.col("old.price")).cast("double") / F.col("old.price").cast("double") * 100
    series = series.filter((F.col("n") >= 2) & (F.col("old.price") > 0)).withColumn("change_pct", change)
    best = first_per_key(series, ["product_id"], F.desc(F.abs("change_pct")), F.asc("presentation_id"))
    if limit is not None:
        best = best.orderBy(F.desc(F.abs("change_pct")), "product_id").limit(limit)
    return best.select("product_id", "presentation_id", F.col("old.price").cast("double").alias("old_price"), F.col("new.price").cast("double").alias("new_price"), "change_pct")


def week_over_week(prices: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """As-of lookup for all products at once: the latest price and the latest one at least 7 days older."""
    rows = prices.filter(trailing("price_date", as_of, days)).withColumn("price", F.coalesce("min_price", "avg_price")).filter("price > 0")
    daily = rows.groupBy("product_id", "price_date").agg(F.min("price").alias("price"))
    last = F.max("price_date").over(Window.partitionBy("product_id"))
    marked = daily.withColumn("last", last).withColumn("old", F.col("price_date") <= F.date_sub("last", 7))
    now, then = F.when(F.col("price_date") == F.col("last"), F.col("price")), F.when(F.col("old"), F.struct("price_date", "price"))
    out = marked.groupBy("product_id").agg(F.max("last").alias("price_date"), F.max(now).alias("now"), F.max(then).alias("before"))
    change = (F.col("now") - F.col("before.price")).cast("double") / F.col("before.price").cast("double") * 100
    return out.select("product_id", text("price_date"), F.col("now").cast("double").alias("price"), F.col("before.price").cast("double").alias("price_before"), change.alias("change_pct"))


def chart(prices: DataFrame, product: int, as_of: str, days: int = 0) -> DataFrame:
    """Of each day: lowest low, highest high, and mean of the middles of rows that have both bounds."""
    rows = optional(prices.filter(trailing("price_date", as_of, days)), product_id=product).filter("min_price > 0 and max_price > 0")
    rows = rows.withColumn("twice", F.col("min_price") + F.col("max_price"))
    daily = rows.groupBy("price_date").agg(F.min("min_price").cast("double").alias("low"), F.max("max_price").cast("double").alias("high"), mean_of_twice("twice").alias("mean"))
    return daily.orderBy("price_date").select(text("price_date"), "low", "high", "mean")


def daily_means(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """Mean of the published means of each product and day; missing and zero ones do not count."""
    rows = prices.filter(trailing("price_date", as_of, days)).filter("avg_price != 0")
    return rows.groupBy("product_id", "price_date").agg(exact_mean("avg_price").alias("mean_price")).select("product_id", text("price_date"), "mean_price")


def trend_lines(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """Least-squares line through each product's daily maxima by index 0, 1, ...; null under two days. Also extremes and their first days."""
    daily = prices.filter(trailing("price_date", as_of, days)).groupBy("product_id", "price_date").agg(F.max("max_price").alias("price")).filter("price is not null")
    x = F.row_number().over(Window.partitionBy("product_id").orderBy("price_date")) - 1
    points = daily.withColumn("x", x.cast("decimal(10,0)"))
    sums = points.groupBy("product_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("x").cast("double").alias("sx"),
        F.sum(F.col("x") * F.col("x")).cast("double").alias("sxx"),
        F.sum("price").cast("double").alias("sy"),
        F.sum(F.col("x") * F.col("price")).cast("double").alias("sxy"),
        F.min(F.struct("price", "price_date")).alias("low"),
        F.min(F.struct((-F.col("price")).alias("price"), F.col("price_date"))).alias("high"),
    )
    below = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(below, F.lit(0.0))
    out = sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    return out.select("product_id", "slope", "intercept", F.col("low.price_date").cast("string").alias("low_date"), F.col("high.price_date").cast("string").alias("high_date"))


def compare_markets(prices: DataFrame, products: DataFrame, first: int, second: int, as_of: str, days: int) -> DataFrame:
    """Latest prices of every series of the first market beside the second's, which may lack it; null keys match."""
    rows = prices.filter(trailing("price_date", as_of, days)).withColumn("price", F.coalesce("avg_price", "min_price"))
    at = lambda market: first_per_key(rows.filter(F.col("market_id") == market), SERIES, *newest_first()).select(*SERIES, "price")
    a, b = at(first).alias("a"), at(second).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in SERIES]
    both = a.join(b, same, "left").select(*(F.col(f"a.{k}").alias(k) for k in SERIES), F.col("a.price").alias("price_a"), F.col("b.price").alias("price_b"))
    difference = F.when(F.col("price_a") > 0, (F.col("price_b") - F.col("price_a")).cast("double") / F.col("price_a").cast("double") * 100)
    named = both.join(products.select("product_id", "category_name", "subcategory_name"), "product_id", "left")
    return named.select(*SERIES, "category_name", "subcategory_name", F.col("price_a").cast("double").alias("price_a"), F.col("price_b").cast("double").alias("price_b"), difference.alias("diff_pct"))


def comparison_totals(compared: DataFrame) -> DataFrame:
    """Matched and all series, by category and subcategory, by category, and overall, in one pass."""
    rolled = compared.rollup("category_name", "subcategory_name").agg(
        F.count("price_b").alias("matched"), F.count(F.lit(1)).alias("series"), F.grouping_id().cast("int").alias("level")
    )
    return rolled.select("category_name", "subcategory_name", "level", "matched", "series")


def choropleth(values: DataFrame, key: str, value: str, colours: int = 7) -> DataFrame:
    """``values`` with a colour: missing or no positive value is 0, equal extremes give 3, else 1 and up by position."""
    positive_ = F.when(F.col(value) > 0, F.col(value))
    bounds = values.agg(F.coalesce(F.min(positive_), F.lit(0.0)).alias("low"), F.coalesce(F.max(positive_), F.lit(1.0)).alias("high"))
    position = (F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    place = F.least(F.floor(position * (colours - 1)) + 1, F.lit(colours)).cast("int")
    colour = F.when(F.coalesce(F.col(value), F.lit(0.0)) <= 0, 0).when(F.col("low") == F.col("high"), 3).otherwise(place)
    # One row of bounds.
    return values.join(F.broadcast(bounds)).select(key, value, colour.cast("int").alias("colour"))


def time_ranges(prices: DataFrame, as_of: str) -> DataFrame:
    """Of each product, the age of its newest row and the shortest range that shows it."""
    newest = prices.groupBy("product_id").agg(F.max("price_date").alias("newest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("newest"))
    label = F.lit("all")
    for name, days in (("1y", 365), ("6m", 180), ("3m", 90), ("1m", 30), ("1w", 7)):
        label = F.when(F.col("age_days") <= days, name).otherwise(label)
    return newest.select("product_id", age.cast("int").alias("age_days")).withColumn("range", label)

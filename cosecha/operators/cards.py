"""Screens as queries: trending products, price cards, charts, comparison totals, rankings and input series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.columns import exact_mean, first_per_key, first_positive, optional, percent_change, text, trailing
from cosecha.operators.prices import newest_first

#: Rows that a market must have in the window, or else all markets count.
LEAST_ROWS = 10


def trending(prices: DataFrame, as_of: str, days: int = 7, market: int | None = None, limit: int = 15, each_way: int = 5) -> DataFrame:
    """Products by the size of the change from the oldest to the newest price of their most changed series.

    A series is a product and presentation, and the market where one is wanted that has
    ``LEAST_ROWS`` rows in the window; it needs two rows. A price is the first of mean,
    high and low that is not 0, else 0; an oldest price of 0 makes no change. ``up`` and
    ``down`` number the largest rises and falls among the ``limit`` products.
    """
    rows = prices.filter(trailing("price_date", as_of, days))
    local = optional(rows, market_id=market)
    by_market = market is not None and local.limit(LEAST_ROWS).count() == LEAST_ROWS
    rows = (local if by_market else rows).withColumn("price", first_positive("avg_price", "max_price", "min_price"))
    keys = ["product_id", "presentation_id", *(["market_id"] if by_market else [])]
    age = F.struct("price_date", "round", "order_id", "line", "price")
    series = rows.groupBy(*keys).agg(F.min(age).alias("old"), F.max(age).alias("new"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    old, new = (F.col(f"{side}.price").cast("double") for side in ("old", "new"))
    series = series.withColumns({"latest_price": new, "change_pct": percent_change(old, new)})
    best = first_per_key(series, ["product_id"], F.desc(F.abs("change_pct")), F.asc_nulls_last("presentation_id"))
    top = best.orderBy(F.desc(F.abs("change_pct")), "product_id").limit(limit)
    # At most ``limit`` rows from here on.
    rank = lambda sign: F.row_number().over(Window.partitionBy(F.signum("change_pct")).orderBy(F.desc(sign * F.col("change_pct")), "product_id"))
    place = lambda sign: F.when((sign * F.col("change_pct") > 0) & (rank(sign) <= each_way), rank(sign)).cast("int")
    return top.select("product_id", "presentation_id", "latest_price", "change_pct", place(1).alias("up"), place(-1).alias("down"))


def _day_means(rows: DataFrame, prefix: str) -> DataFrame:
    """Of each product the last day's means of lows and highs, of those above 0; 0 without any."""
    last = F.max("price_date").over(Window.partitionBy("product_id"))
    day = rows.withColumn("_last", last).filter("price_date = _last")
    bound = lambda c: F.when(F.coalesce(c, "avg_price") > 0, F.coalesce(c, "avg_price"))
    day = day.withColumns({"_low": bound("min_price"), "_high": bound("max_price")})
    means = (F.coalesce(exact_mean(c), F.lit(0.0)).alias(f"{prefix}{c}") for c in ("_low", "_high"))
    return day.groupBy("product_id").agg(F.max("price_date").alias(f"{prefix}date"), *means)


def price_cards(prices: DataFrame, as_of: str, days: int = 14, market: int | None = None, one_presentation: bool = True) -> DataFrame:
    """A card for each product: its commonest presentation and units, latest low and high, and the change in a week.

    With a ``market`` that has the bucket, its newest row gives the prices; otherwise the
    last day's means over all markets. The week before is the last day at least 7 days
    older, at the market where one is given. ``one_presentation`` off mixes all buckets.
    """
    rows = prices.filter(trailing("price_date", as_of, days))
    keys = ["presentation_id", "units_id"]
    newest = F.max(F.struct("price_date", "round", "order_id", "line"))
    counts = rows.groupBy("product_id", *keys).agg(F.count(F.lit(1)).alias("n"), newest.alias("newest"))
    common = first_per_key(counts, ["product_id"], F.desc("n"), F.desc("newest"), *(F.asc_nulls_last(k) for k in keys))
    common = common.select("product_id", *(F.col(k).alias(f"common_{k}") for k in keys))
    if one_presentation:
        rows = rows.join(common, "product_id")
        rows = rows.filter(F.col("presentation_id").eqNullSafe(F.col("common_presentation_id")) & F.col("units_id").eqNullSafe(F.col("common_units_id")))
    national = _day_means(rows, "n")
    cards = common.join(national, "product_id")
    order = newest_first()
    if market is not None:
        own = first_per_key(rows.filter(F.col("market_id") == market), ["product_id"], *order)
        side = lambda c: F.coalesce(c, "avg_price", F.lit(0)).cast("double")
        own = own.select("product_id", F.col("price_date").alias("mdate"), side("min_price").alias("m_low"), side("max_price").alias("m_high"))
        cards = cards.join(own, "product_id", "left")
    else:
        cards = cards.withColumns({"mdate": F.lit(None).cast("date"), "m_low": F.lit(None).cast("double"), "m_high": F.lit(None).cast("double")})
    pick = lambda name: F.when(F.col("mdate").isNotNull(), F.col(f"m{name}")).otherwise(F.col(f"n{name}"))
    cards = cards.withColumns({"price_date": pick("date"), "low": pick("_low"), "high": pick("_high")})
    older = rows.drop("common_presentation_id", "common_units_id").join(cards.select("product_id", F.date_sub("price_date", 7).alias("_until")), "product_id").filter("price_date <= _until").drop("_until")
    if market is not None:
        last = first_per_key(older.filter(F.col("market_id") == market), ["product_id"], *order)
        middle = (F.col("min_price").cast("double") + F.col("max_price").cast("double")) / 2
        before = last.select("product_id", F.when(F.col("avg_price") != 0, F.col("avg_price").cast("double")).otherwise(middle).alias("before"))
    else:
        before = _day_means(older, "p").select("product_id", ((F.col("p_low") + F.col("p_high")) / 2).alias("before"))
    cards = cards.join(before, "product_id", "left").withColumn("now", (F.col("low") + F.col("high")) / 2)
    change = F.when((F.col("before") > 0) & (F.col("now") > 0), percent_change(F.col("before"), F.col("now")))
    scope = F.when(F.col("mdate").isNotNull(), "market").otherwise("national")
    return cards.select("product_id", *(f"common_{k}" for k in keys), scope.alias("scope"), text("price_date"), "low", "high", change.alias("week_change_pct"))


def chart_series(prices: DataFrame, as_of: str, days: int = 0, **equals: object) -> DataFrame:
    """Of each day: lowest low, highest high and mean of the middles; a bound that is null or not above 0 is the mean price, else the other bound."""
    rows = optional(prices.filter(trailing("price_date", as_of, days)), **equals)
    bound = lambda own, other: F.when(F.col(own) > 0, F.col(own)).otherwise(F.coalesce("avg_price", other))
    rows = rows.withColumns({"low": bound("min_price", "max_price"), "high": bound("max_price", "min_price")})
    rows = rows.filter("low is not null and high is not null and (low > 0 or high > 0)").withColumn("twice", F.col("low") + F.col("high"))
    mean = F.sum("twice").cast("double") / (F.count("twice") * 2)
    daily = rows.groupBy("product_id", "price_date").agg(F.min("low").cast("double").alias("low"), F.max("high").cast("double").alias("high"), mean.alias("mean"))
    return daily.select("product_id", text("price_date"), "low", "high", "mean")


def comparison_means(compared: DataFrame) -> DataFrame:
    """Mean difference in percent of matched series, and their number, by category and subcategory, by category, and overall; to six decimals, as sums of doubles depend on order."""
    named = compared.select(F.coalesce("category_name", F.lit("Otro")).alias("category"), F.coalesce("subcategory_name", F.lit("General")).alias("subcategory"), "diff_pct")
    rolled = named.rollup("category", "subcategory").agg(
        F.round(F.avg("diff_pct"), 6).alias("mean_diff_pct"), F.count("diff_pct").alias("matched"), F.count(F.lit(1)).alias("series"), F.grouping_id().cast("int").alias("level")
    )
    return rolled.select("category", "subcategory", "level", "mean_diff_pct", "matched", "series")


def market_ranking(prices: DataFrame, as_of: str, days: int, ascending: bool = True, **equals: object) -> DataFrame:
    """The latest row of each product and market, numbered by price within the product: the first of mean and low that is not 0, else 0."""
    rows = optional(prices.filter(trailing("price_date", as_of, days)), **equals)
    latest = first_per_key(rows, ["product_id", "market_id"], *newest_first()).withColumn("price", first_positive("avg_price", "min_price"))
    order = (F.asc if ascending else F.desc)("price")
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(order, F.asc_nulls_last("market_id")))
    return latest.select("product_id", "market_id", text("price_date"), F.col("price").cast("double").alias("price"), place.alias("place"))


def mean_gaps(prices: DataFrame, as_of: str, days: int) -> DataFrame:
    """Each product's daily mean with the mean of its days: the line across its chart."""
    rows = prices.filter(trailing("price_date", as_of, days)).filter("max_price is not null")
    daily = rows.groupBy("product_id", "price_date").agg(F.max("max_price").alias("price"))
    lines = daily.groupBy("product_id").agg(exact_mean("price").alias("mean_line"), F.count(F.lit(1)).alias("days"))
    return lines


def top_sum(rows: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """The sum of the ``k`` largest values, one row: 0 without any."""
    top = rows.orderBy(F.desc_nulls_last(value), key).limit(k)
    return top.agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total"), F.count(F.lit(1)).alias("members"))


def input_headers(inputs: DataFrame) -> DataFrame:
    """Of each input its commonest presentation (newest first on ties), and the newest price in it."""
    named = inputs.withColumn("presentation", F.nullif(F.trim("presentation"), F.lit("")))
    counts = named.filter("presentation is not null").groupBy("input_id", "presentation").agg(F.count(F.lit(1)).alias("n"), F.max("price_date").alias("newest"))
    common = first_per_key(counts, ["input_id"], F.desc("n"), F.desc("newest"), F.asc("presentation")).select("input_id", F.col("presentation").alias("common"))
    rows = named.join(common, "input_id", "left").filter(F.col("common").isNull() | (F.col("presentation") == F.col("common")))
    newest = first_per_key(rows, ["input_id"], F.desc("price_date"), F.desc("order_id"), F.desc("line"), F.desc("avg_price"))
    return newest.select("input_id", F.col("common").alias("presentation"), F.col("avg_price").cast("double").alias("avg_price"), text("price_date"), "department_id")


def input_series(inputs: DataFrame, as_of: str, days: int, presentation: str | None = None) -> DataFrame:
    """The chart of each input and place: the daily mean, without prices that are 0 or null.

    The places of an input are its cities if any of its rows in the window has one, else its departments.
    """
    rows = optional(inputs.filter(trailing("price_date", as_of, days)), presentation=presentation)
    by_city = F.max(F.col("city_id").isNotNull()).over(Window.partitionBy("input_id"))
    rows = rows.withColumn("_cities", by_city)
    place = F.when(F.col("_cities"), F.col("city_id")).otherwise(F.col("department_id"))
    rows = rows.select("input_id", F.when(F.col("_cities"), "city").otherwise("department").alias("level"), place.alias("place_id"), "price_date", "avg_price")
    daily = rows.filter("avg_price != 0 and place_id is not null").groupBy("input_id", "level", "place_id", "price_date").agg(exact_mean("avg_price").alias("value"))
    return daily.select("input_id", "level", "place_id", text("price_date"), "value")


def code_order(inputs: DataFrame) -> DataFrame:
    """Inputs numbered by classification code, those without one last, then by name."""
    order = Window.partitionBy("category_name").orderBy(F.asc_nulls_last("cpc_code"), F.asc("product_name"), F.asc("product_id"))
    return inputs.select("category_name", "cpc_code", "product_id", F.row_number().over(order).alias("place"))


def single(rows: DataFrame, required: bool = True) -> DataFrame:
    """``rows`` if they are one row; several, or none where one is ``required``, are an error."""
    found = rows.limit(2).count()
    if found > 1 or (required and found == 0):
        raise LookupError(f"one row is wanted, {'several' if found else 'none'} found")
    return rows


def page(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start`` + ``size`` - 1 in ``order``, which must break all ties."""
    return rows.orderBy(*order).offset(start).limit(size)


def matching_names(rows: DataFrame, name: str, subtitle: str, search: str, least: int = 2) -> DataFrame:
    """Rows whose name or subtitle has ``search`` whatever the case; none below ``least`` characters."""
    wanted = search.lower()
    found = F.lower(name).contains(wanted) | F.lower(F.coalesce(subtitle, F.lit(""))).contains(wanted)
    return rows.filter(found if len(search) >= least else F.lit(False))

"""Price queries and their oracles."""

from __future__ import annotations

from cosecha.operators import prices as ops
from cosecha.operators.supply import markets_of
from cosecha.plans.registry import Registry
from cosecha.plans.views import AS_OF, Views, sql, sql_with

registry = Registry()

#: Parameters of the registered queries.
MARKET, OTHER_MARKET, PRODUCT, PRESENTATION, UNITS, DAYS = 1, 2, 1, "N", "O", 730

_SINCE = f"price_date >= DATE '{AS_OF}' - {DAYS}"
_POSITIVE = "COALESCE(avg_price, min_price, max_price, 0) > 0"
_EFF2 = "COALESCE(avg_price + avg_price, min_price + max_price)"
_MEAN2 = f"CAST(SUM({_EFF2}) AS DOUBLE) / NULLIF(COUNT({_EFF2}) * 2, 0)"
_NEWEST = "price_date DESC, round DESC, order_id DESC, line DESC, max_price DESC NULLS LAST, min_price DESC NULLS LAST"
_FIRST = "CASE WHEN avg_price <> 0 THEN avg_price WHEN max_price <> 0 THEN max_price WHEN min_price <> 0 THEN min_price ELSE 0 END"


def _by_department(where: str) -> str:
    return sql(f"""
SELECT department_id, {_MEAN2} AS avg_price, COUNT(*) AS observation_count
FROM prices JOIN city ON prices.city_id = city.city_id WHERE {where} AND {_POSITIVE} GROUP BY department_id""")


@registry.query("I10_prices_by_department", _by_department(_SINCE))
def prices_by_department(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.by_department(v.prices, v.cities, AS_OF, DAYS)


@registry.query("I11_prices_by_department_for_product", _by_department(f"product_id = {PRODUCT} AND presentation_id = '{PRESENTATION}' AND units_id = '{UNITS}'"))
def prices_by_department_for_product(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.by_department(v.prices, v.cities, AS_OF, 0, PRODUCT, PRESENTATION, UNITS)


@registry.query("I12_national_price_averages", sql_with(
    f"latest AS (SELECT * FROM prices WHERE {_SINCE} QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, presentation_id, units_id, market_id ORDER BY {_NEWEST}) = 1)",
    f"SELECT product_id, presentation_id, units_id, {_MEAN2} AS avg_price, CAST(MAX(price_date) AS VARCHAR) AS price_date, COUNT(*) AS market_count FROM latest GROUP BY ALL"))
def national_price_averages(spark, sf_dir):
    return ops.national_averages(Views(spark, sf_dir).price_lines, AS_OF, DAYS)


@registry.query("I17_price_markets_for_product", sql(f"SELECT DISTINCT market_id FROM prices WHERE {_SINCE} AND product_id = {PRODUCT} AND market_id IS NOT NULL"))
def price_markets_for_product(spark, sf_dir):
    return markets_of(Views(spark, sf_dir).price_lines, "price_date", AS_OF, DAYS, product_id=PRODUCT)


@registry.query("I19_product_presentations", sql(f"""
SELECT DISTINCT presentation_id, units_id FROM prices WHERE product_id = {PRODUCT} AND {_POSITIVE} AND presentation_id IS NOT NULL AND units_id IS NOT NULL"""))
def product_presentations(spark, sf_dir):
    return ops.presentations(Views(spark, sf_dir).price_lines, PRODUCT, AS_OF, 0)


_LATEST_PRODUCT = f"ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) = 1"


@registry.query("J5_latest_price_per_product", sql(f"""
SELECT product_id, CAST(market_id AS VARCHAR) AS market_id, CAST(price_date AS VARCHAR) AS price_date, CAST(min_price AS DOUBLE) AS min_price, CAST(max_price AS DOUBLE) AS max_price, CAST(avg_price AS DOUBLE) AS avg_price
FROM prices WHERE {_SINCE} QUALIFY {_LATEST_PRODUCT}"""))
def latest_price_per_product(spark, sf_dir):
    return ops.latest_per_product(Views(spark, sf_dir).price_lines, AS_OF, DAYS)


@registry.query("J6_watchlist_with_default_market", sql_with(
    f"""here AS (SELECT *, 'mercado' AS scope FROM prices WHERE {_SINCE} AND market_id = {MARKET} QUALIFY {_LATEST_PRODUCT}),
there AS (SELECT *, 'nacional' AS scope FROM prices WHERE {_SINCE} AND product_id NOT IN (SELECT product_id FROM here) QUALIFY {_LATEST_PRODUCT})""",
    "SELECT product_id, scope, CAST(price_date AS VARCHAR) AS price_date, CAST(max_price AS DOUBLE) AS max_price FROM (SELECT * FROM here UNION ALL SELECT * FROM there)"))
def watchlist_with_default_market(spark, sf_dir):
    return ops.with_default_market(Views(spark, sf_dir).price_lines, MARKET, AS_OF, DAYS)


@registry.query("J18_price_movers", sql_with(
    f"""priced AS (SELECT *, {_FIRST} AS price FROM prices WHERE {_SINCE}),
series AS (SELECT product_id, presentation_id, FIRST(price ORDER BY price_date, round, order_id, line, price) AS old_p, FIRST(price ORDER BY price_date DESC, round DESC, order_id DESC, line DESC, price DESC) AS new_p, COUNT(*) AS n FROM priced GROUP BY ALL),
changes AS (SELECT *, CAST(new_p - old_p AS DOUBLE) / CAST(old_p AS DOUBLE) * 100 AS change_pct FROM series WHERE n >= 2 AND old_p > 0),
best AS (SELECT * FROM changes QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY ABS(change_pct) DESC, presentation_id) = 1)""",
    "SELECT product_id, presentation_id, CAST(old_p AS DOUBLE) AS old_price, CAST(new_p AS DOUBLE) AS new_price, change_pct FROM best ORDER BY ABS(change_pct) DESC, product_id LIMIT 15"))
def price_movers(spark, sf_dir):
    return ops.movers(Views(spark, sf_dir).price_lines, AS_OF, DAYS)


@registry.query("J19_week_over_week", sql_with(
    """daily AS (SELECT product_id, price_date, MIN(COALESCE(min_price, avg_price)) AS price FROM prices WHERE COALESCE(min_price, avg_price) > 0 GROUP BY ALL),
marked AS (SELECT *, MAX(price_date) OVER (PARTITION BY product_id) AS last FROM daily),
both_ AS (SELECT product_id, MAX(last) AS last, MAX(CASE WHEN price_date = last THEN price END) AS now, ARG_MAX(price, price_date) FILTER (price_date <= last - 7) AS before FROM marked GROUP BY product_id)""",
    "SELECT product_id, CAST(last AS VARCHAR) AS price_date, CAST(now AS DOUBLE) AS price, CAST(before AS DOUBLE) AS price_before, CAST(now - before AS DOUBLE) / CAST(before AS DOUBLE) * 100 AS change_pct FROM both_"))
def week_over_week(spark, sf_dir):
    return ops.week_over_week(Views(spark, sf_dir).price_lines, AS_OF, 0)


@registry.query("J21_price_chart", sql(f"""
SELECT CAST(price_date AS VARCHAR) AS price_date, CAST(MIN(min_price) AS DOUBLE) AS low, CAST(MAX(max_price) AS DOUBLE) AS high, CAST(SUM(min_price + max_price) AS DOUBLE) / (COUNT(*) * 2) AS mean
FROM prices WHERE product_id = {PRODUCT} AND min_price > 0 AND max_price > 0 GROUP BY price_date"""))
def price_chart(spark, sf_dir):
    return ops.chart(Views(spark, sf_dir).price_lines, PRODUCT, AS_OF)


@registry.query("E17_daily_means", sql("""
SELECT product_id, CAST(price_date AS VARCHAR) AS price_date, CAST(SUM(avg_price) AS DOUBLE) / COUNT(avg_price) AS mean_price FROM prices WHERE avg_price <> 0 GROUP BY product_id, price_date"""))
def daily_means(spark, sf_dir):
    return ops.daily_means(Views(spark, sf_dir).price_lines, AS_OF, 0)


@registry.query("J22_market_ranking", sql_with(
    f"""latest AS (SELECT product_id, market_id, {_FIRST} AS price FROM prices WHERE presentation_id = '{PRESENTATION}' AND market_id IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, market_id ORDER BY {_NEWEST}) = 1),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY price, market_id) AS spot, COUNT(*) OVER (PARTITION BY product_id) AS n FROM latest WHERE price > 0)""",
    """SELECT product_id, CAST(SUM(price) FILTER (spot * 2 BETWEEN n AND n + 2) AS DOUBLE) / COUNT(*) FILTER (spot * 2 BETWEEN n AND n + 2) AS median_price,
CAST(SUM(price) AS DOUBLE) / COUNT(*) AS mean_price, COUNT(*) AS market_count FROM placed GROUP BY product_id"""))
def market_ranking(spark, sf_dir):
    return ops.market_ranking(Views(spark, sf_dir).price_lines, PRESENTATION, AS_OF, 0)


_COMPARED = f"""
one AS (SELECT *, COALESCE(avg_price, min_price) AS price FROM prices WHERE market_id = {MARKET} QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, presentation_id, units_id ORDER BY {_NEWEST}) = 1),
two AS (SELECT *, COALESCE(avg_price, min_price) AS price FROM prices WHERE market_id = {OTHER_MARKET} QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, presentation_id, units_id ORDER BY {_NEWEST}) = 1),
compared AS (SELECT one.product_id, one.presentation_id, one.units_id, category_name, subcategory_name, CAST(one.price AS DOUBLE) AS price_a, CAST(two.price AS DOUBLE) AS price_b,
  CASE WHEN one.price > 0 THEN CAST(two.price - one.price AS DOUBLE) / CAST(one.price AS DOUBLE) * 100 END AS diff_pct
  FROM one LEFT JOIN two ON one.product_id = two.product_id AND one.presentation_id IS NOT DISTINCT FROM two.presentation_id AND one.units_id IS NOT DISTINCT FROM two.units_id
  LEFT JOIN product ON one.product_id = product.product_id)"""


@registry.query("J25_market_price_comparison", sql_with(_COMPARED, "SELECT * FROM compared"))
def market_price_comparison(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.compare_markets(v.price_lines, v.products, MARKET, OTHER_MARKET, AS_OF, 0)


@registry.query("E19_comparison_totals", sql_with(_COMPARED, """
SELECT category_name, subcategory_name, CAST(GROUPING(category_name, subcategory_name) AS INTEGER) AS level, COUNT(price_b) AS matched, COUNT(*) AS series
FROM compared GROUP BY ROLLUP (category_name, subcategory_name)"""))
def comparison_totals(spark, sf_dir):
    return ops.comparison_totals(market_price_comparison(spark, sf_dir))


@registry.query("E23_trend_lines", sql_with(
    """daily AS (SELECT product_id, price_date, MAX(max_price) AS price FROM prices GROUP BY ALL HAVING MAX(max_price) IS NOT NULL),
points AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY price_date) - 1 AS x FROM daily),
sums AS (SELECT product_id, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(x * x) AS DOUBLE) AS sxx, CAST(SUM(price) AS DOUBLE) AS sy, CAST(SUM(x * price) AS DOUBLE) AS sxy,
  FIRST(price_date ORDER BY price, price_date) AS low_date, FIRST(price_date ORDER BY price DESC, price_date) AS high_date FROM points GROUP BY product_id),
lines_ AS (SELECT *, (n * sxy - sx * sy) / NULLIF(n * sxx - sx * sx, 0) AS slope FROM sums)""",
    "SELECT product_id, slope, (sy - slope * sx) / n AS intercept, CAST(low_date AS VARCHAR) AS low_date, CAST(high_date AS VARCHAR) AS high_date FROM lines_"))
def trend_lines(spark, sf_dir):
    return ops.trend_lines(Views(spark, sf_dir).price_lines, AS_OF, 0)


@registry.query("J28_choropleth", sql_with(
    f"per AS (SELECT department_id, {_MEAN2} AS avg_price FROM prices JOIN city ON prices.city_id = city.city_id WHERE {_SINCE} AND {_POSITIVE} GROUP BY department_id), bounds AS (SELECT COALESCE(MIN(avg_price) FILTER (avg_price > 0), 0) AS low, COALESCE(MAX(avg_price) FILTER (avg_price > 0), 1) AS high FROM per)",
    """SELECT department_id, avg_price, CAST(CASE WHEN COALESCE(avg_price, 0) <= 0 THEN 0 WHEN low = high THEN 3
  ELSE LEAST(FLOOR((avg_price - low) / NULLIF(high - low, 0) * 6) + 1, 7) END AS INTEGER) AS colour FROM per, bounds"""))
def choropleth(spark, sf_dir):
    return ops.choropleth(prices_by_department(spark, sf_dir), "department_id", "avg_price")


@registry.query("J29_time_ranges", sql_with(
    f"newest AS (SELECT product_id, CAST(date_diff('day', MAX(price_date), DATE '{AS_OF}') AS INTEGER) AS age_days FROM prices GROUP BY product_id)",
    "SELECT *, CASE WHEN age_days <= 7 THEN '1w' WHEN age_days <= 30 THEN '1m' WHEN age_days <= 90 THEN '3m' WHEN age_days <= 180 THEN '6m' WHEN age_days <= 365 THEN '1y' ELSE 'all' END AS range FROM newest"))
def time_ranges(spark, sf_dir):
    return ops.time_ranges(Views(spark, sf_dir).price_lines, AS_OF)

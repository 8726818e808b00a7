"""Row feeds and small summaries, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.operators import browse as ops
from cosecha.plans.registry import Registry
from cosecha.plans.views import AS_OF, Views, sql, sql_with
from cosecha.sources.layouts import classification

registry = Registry()

#: Parameters of the registered queries.
MARKET, PRODUCT, DAYS = 1, 1, 730

_SINCE = f"price_date >= DATE '{AS_OF}' - {DAYS}"
_FIRST = "CASE WHEN avg_price <> 0 THEN avg_price WHEN max_price <> 0 THEN max_price WHEN min_price <> 0 THEN min_price ELSE 0 END"
_MONEY = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("min_price", "max_price", "avg_price"))


@registry.query("J3_price_series", sql(f"""
SELECT product_id, market_name, presentation_id, units_id, CAST(price_date AS VARCHAR) AS price_date, round, {_MONEY}
FROM prices LEFT JOIN market ON prices.market_id = market.market_id WHERE product_id = {PRODUCT}"""))
def price_series(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.price_series(v.price_lines, v.markets, AS_OF, 0, product_id=PRODUCT)


@registry.query("J7_newest_prices", sql(f"""
SELECT product_id, market_name, presentation_id, units_id, CAST(price_date AS VARCHAR) AS price_date, round, {_MONEY}
FROM prices LEFT JOIN market ON prices.market_id = market.market_id WHERE price_date >= DATE '{AS_OF}' - 7"""))
def newest_prices(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.price_series(v.price_lines, v.markets, AS_OF, 7)


@registry.query("J9_market_products", sql(f"""
SELECT p.product_id, product_name, category_name, COUNT(*) AS lines, CAST(MAX(price_date) AS VARCHAR) AS price_date
FROM prices p JOIN product ON p.product_id = product.product_id WHERE market_id = {MARKET} AND {_SINCE} GROUP BY ALL"""))
def market_products(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.market_products(v.price_lines, v.products, MARKET, AS_OF, DAYS)


@registry.query("J10_market_supply_rows", sql(f"""
SELECT CAST(observation_date AS VARCHAR) AS observation_date, product_id, city_id, origin, CAST(quantity_kg AS DOUBLE) AS quantity_kg FROM supply WHERE market_id = {MARKET}"""))
def market_supply_rows(spark, sf_dir):
    return ops.supply_rows(Views(spark, sf_dir).supply, AS_OF, 0, market_id=MARKET)


@registry.query("J12_product_supply_rows", sql(f"""
SELECT CAST(observation_date AS VARCHAR) AS observation_date, product_id, city_id, origin, CAST(quantity_kg AS DOUBLE) AS quantity_kg FROM supply WHERE product_id = {PRODUCT}"""))
def product_supply_rows(spark, sf_dir):
    return ops.supply_rows(Views(spark, sf_dir).supply, AS_OF, 0, product_id=PRODUCT)


@registry.query("J40_scoped_prices", sql(f"SELECT presentation_id, COUNT(*) AS lines FROM prices WHERE market_id = {MARKET} GROUP BY presentation_id"))
def scoped_prices(spark, sf_dir):
    rows = ops.scoped(Views(spark, sf_dir).price_lines, "mercado", MARKET)
    return rows.groupBy("presentation_id").agg(F.count(F.lit(1)).alias("lines"))


@registry.query("E15_common_presentation", sql_with(
    f"counts AS (SELECT product_id, presentation_id, COUNT(*) AS lines, MAX(price_date) AS newest FROM prices WHERE {_SINCE} GROUP BY ALL)",
    "SELECT product_id, presentation_id, lines FROM counts QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY lines DESC, newest DESC, presentation_id) = 1"))
def common_presentation(spark, sf_dir):
    return ops.common_presentation(Views(spark, sf_dir).price_lines, AS_OF, DAYS)


@registry.query("J24_filtered_inputs", sql("""
SELECT input_id, department_id, presentation, CAST(SUM(avg_price) AS DOUBLE) / COUNT(avg_price) AS mean_price, COUNT(*) AS lines
FROM input_prices WHERE department_id IN (1, 2) AND presentation IN ('A', 'N') GROUP BY ALL"""))
def filtered_inputs(spark, sf_dir):
    return ops.filter_inputs(Views(spark, sf_dir).input_prices, departments=[1, 2], presentations=["A", "N"])


@registry.query("E27_filter_values", sql("""
SELECT product_id, STRING_AGG(DISTINCT presentation_id, ',' ORDER BY presentation_id) AS presentations, STRING_AGG(DISTINCT units_id, ',' ORDER BY units_id) AS units FROM prices GROUP BY product_id"""))
def filter_values(spark, sf_dir):
    return ops.filter_values(Views(spark, sf_dir).price_lines)


@registry.query("J31_spark_signs", sql_with(
    f"""priced AS (SELECT *, {_FIRST} AS price FROM prices WHERE {_SINCE}),
ends_ AS (SELECT product_id, FIRST(price ORDER BY price_date, round, order_id, line, price) AS a, FIRST(price ORDER BY price_date DESC, round DESC, order_id DESC, line DESC, price DESC) AS b, MIN(price_date) AS first_day, MAX(price_date) AS last_day FROM priced WHERE price > 0 GROUP BY product_id)""",
    "SELECT product_id, CAST(b >= a AS INTEGER) AS rising, CAST(first_day = last_day AS INTEGER) AS one_day FROM ends_"))
def spark_signs(spark, sf_dir):
    return ops.spark_signs(Views(spark, sf_dir).price_lines, AS_OF, DAYS)


@registry.query("E31_distinct_origins", sql("SELECT DISTINCT origin FROM supply WHERE origin IS NOT NULL AND origin <> ''"))
def distinct_origins(spark, sf_dir):
    return ops.distinct_values(Views(spark, sf_dir).supply, "origin")


@registry.query("C16_found_errors", """
SELECT event_id AS error_id, event_type AS error_type, props AS message FROM events WHERE event_type = 'error' AND NOT value > 20 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND contains(lower(props), '"k": 1')""")
def found_errors(spark, sf_dir):
    events = Views(spark, sf_dir).table("events")
    errors = events.select(F.col("event_id").alias("error_id"), F.col("event_type").alias("error_type"), F.col("ts").alias("created_at"), (F.col("value") > 20).alias("resolved"), F.col("props").alias("message"))
    return ops.find_errors(errors, "error", False, "2024-01-05", "2024-01-20", '"K": 1').select("error_id", "error_type", "message")


@registry.query("A18_classification", """
WITH codes AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS code FROM part)
SELECT code, 'T' || code AS title, CASE length(code) WHEN 1 THEN 'section' WHEN 2 THEN 'division' WHEN 3 THEN 'group' WHEN 4 THEN 'class' WHEN 5 THEN 'subclass' ELSE 'product' END AS level,
  CASE WHEN length(code) > 5 THEN left(code, 5) WHEN length(code) > 1 THEN left(code, length(code) - 1) END AS parent_code, CASE WHEN length(code) > 1 THEN left(code, 1) END AS section_code,
  CASE WHEN length(code) > 2 THEN left(code, 2) END AS division_code, CASE WHEN length(code) > 3 THEN left(code, 3) END AS group_code, CASE WHEN length(code) > 4 THEN left(code, 4) END AS class_code FROM codes""")
def classified(spark, sf_dir):
    code = F.col("p_partkey").cast("string")
    rows = Views(spark, sf_dir).table("part").select(F.concat(F.lit(" '"), code, F.lit("'")).alias("code"), F.concat(F.lit("T"), code, F.lit(" ")).alias("title"))
    return classification(rows)

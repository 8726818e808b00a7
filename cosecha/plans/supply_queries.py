"""Supply queries and their oracles."""

from __future__ import annotations

from cosecha.operators import supply as ops
from cosecha.plans.registry import Registry
from cosecha.plans.views import AS_OF, Views, sql

registry = Registry()

#: Parameters of the registered queries.
MARKET, OTHER_MARKET, PRODUCT, ORIGIN, DAYS = 1, 2, 1, "NATION_7", 730

_SINCE = f"observation_date >= DATE '{AS_OF}' - {DAYS}"


def _summary(where: str) -> str:
    return sql(f"""
SELECT COALESCE(CAST(SUM(quantity_kg) AS DOUBLE), 0) AS total_kg,
  CASE WHEN COUNT(DISTINCT observation_date) > 0 THEN COALESCE(CAST(SUM(quantity_kg) AS DOUBLE), 0) / COUNT(DISTINCT observation_date) ELSE 0 END AS daily_avg_kg,
  COUNT(DISTINCT observation_date) AS num_days, CAST(MIN(observation_date) AS VARCHAR) AS oldest_obs, CAST(MAX(observation_date) AS VARCHAR) AS newest_obs
FROM supply WHERE {where}""")


@registry.query("I1_market_supply_summary", _summary(f"{_SINCE} AND market_id = {MARKET}"))
def market_supply_summary(spark, sf_dir):
    return ops.summary(Views(spark, sf_dir).arrivals, AS_OF, DAYS, market_id=MARKET)


@registry.query("I1_empty_supply_summary", _summary("observation_date >= DATE '1900-01-01' AND market_id = -1"))
def empty_supply_summary(spark, sf_dir):
    return ops.summary(Views(spark, sf_dir).arrivals, AS_OF, 0, market_id=-1)


@registry.query("I2_market_top_products", sql(f"""
SELECT t.product_id, product_name, total_kg, newest_obs FROM (
  SELECT product_id, CAST(SUM(quantity_kg) AS DOUBLE) AS total_kg, CAST(MAX(observation_date) AS VARCHAR) AS newest_obs
  FROM supply WHERE {_SINCE} AND market_id = {MARKET} GROUP BY product_id ORDER BY SUM(quantity_kg) DESC, product_id LIMIT 10) t
LEFT JOIN product ON t.product_id = product.product_id"""))
def market_top_products(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.top_products(v.arrivals, v.products, AS_OF, DAYS, 10, market=MARKET)


def _origins(where: str, limit: str) -> str:
    return sql(f"""
SELECT COALESCE(NULLIF(origin, ''), 'Desconocido') AS dept_name, CAST(SUM(quantity_kg) AS DOUBLE) AS total_kg, CAST(MAX(observation_date) AS VARCHAR) AS newest_obs
FROM supply WHERE {where} GROUP BY 1 ORDER BY SUM(quantity_kg) DESC, 1 {limit}""")


@registry.query("I3_market_top_provenance", _origins(f"{_SINCE} AND market_id = {MARKET}", "LIMIT 15"))
def market_top_provenance(spark, sf_dir):
    return ops.top_origins(Views(spark, sf_dir).supply, AS_OF, DAYS, 15, market_id=MARKET)


@registry.query("I4_product_supply_summary", _summary(f"observation_date >= DATE '1900-01-01' AND product_id = {PRODUCT} AND COALESCE(origin, '') = '{ORIGIN}'"))
def product_supply_summary(spark, sf_dir):
    return ops.summary(Views(spark, sf_dir).supply, AS_OF, 0, ORIGIN, product_id=PRODUCT)


@registry.query("I5_product_top_destinations", sql(f"""
SELECT t.market_id, market_name, total_kg, newest_obs FROM (
  SELECT market_id, CAST(SUM(quantity_kg) AS DOUBLE) AS total_kg, CAST(MAX(observation_date) AS VARCHAR) AS newest_obs
  FROM supply WHERE {_SINCE} AND product_id = {PRODUCT} AND market_id IS NOT NULL GROUP BY market_id ORDER BY SUM(quantity_kg) DESC, market_id LIMIT 15) t
LEFT JOIN market ON t.market_id = market.market_id"""))
def product_top_destinations(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.top_destinations(v.arrivals, v.markets, AS_OF, DAYS, 15, product=PRODUCT)


@registry.query("I6_product_top_origins", _origins(f"observation_date >= DATE '1900-01-01' AND product_id = {PRODUCT}", "LIMIT 15"))
def product_top_origins(spark, sf_dir):
    return ops.top_origins(Views(spark, sf_dir).supply, AS_OF, 0, 15, product_id=PRODUCT)


@registry.query("I7_product_supply_by_date", sql(f"""
SELECT CAST(observation_date AS VARCHAR) AS observation_date, CAST(SUM(quantity_kg) AS DOUBLE) AS total_kg
FROM supply WHERE product_id = {PRODUCT} GROUP BY observation_date"""))
def product_supply_by_date(spark, sf_dir):
    return ops.by_date(Views(spark, sf_dir).arrivals, AS_OF, 0, product_id=PRODUCT)


def _departments(where: str) -> str:
    return sql(f"SELECT department_id, CAST(SUM(quantity_kg) AS DOUBLE) AS total_kg FROM supply JOIN city ON supply.city_id = city.city_id WHERE {where} GROUP BY department_id")


@registry.query("I8_supply_by_department", _departments(_SINCE))
def supply_by_department(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.by_department(v.arrivals, v.cities, AS_OF, DAYS)


@registry.query("I9_supply_by_department_for_product", _departments(f"{_SINCE} AND product_id = {PRODUCT}"))
def supply_by_department_for_product(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.by_department(v.arrivals, v.cities, AS_OF, DAYS, PRODUCT)


@registry.query("I13_national_supply_averages", sql(f"""
SELECT product_id, CAST(SUM(kg) AS DOUBLE) / COUNT(kg) AS avg_kg_per_market, CAST(SUM(kg) AS DOUBLE) AS total_kg, COUNT(kg) AS market_count
FROM (SELECT product_id, market_id, SUM(quantity_kg) AS kg FROM supply WHERE {_SINCE} AND market_id IS NOT NULL GROUP BY ALL) GROUP BY product_id"""))
def national_supply_averages(spark, sf_dir):
    return ops.national_averages(Views(spark, sf_dir).arrivals, AS_OF, DAYS)


@registry.query("I18_supply_markets_for_product", sql(f"SELECT DISTINCT market_id FROM supply WHERE {_SINCE} AND product_id = {PRODUCT} AND market_id IS NOT NULL"))
def supply_markets_for_product(spark, sf_dir):
    return ops.markets_of(Views(spark, sf_dir).arrivals, "observation_date", AS_OF, DAYS, product_id=PRODUCT)


@registry.query("J11_top_supplied_products", sql("""
SELECT product_id, CAST(SUM(quantity_kg) AS DOUBLE) AS total_kg, CAST(MAX(observation_date) AS VARCHAR) AS newest_obs FROM supply GROUP BY product_id"""))
def top_supplied_products(spark, sf_dir):
    return ops.top(Views(spark, sf_dir).arrivals, "product_id", AS_OF, 0, None)


@registry.query("J26_market_supply_comparison", sql(f"""
SELECT a.product_id, category_name, CAST(a.kg AS DOUBLE) AS kg_a, CAST(b.kg AS DOUBLE) AS kg_b,
  CASE WHEN a.kg > 0 THEN CAST(b.kg - a.kg AS DOUBLE) / CAST(a.kg AS DOUBLE) * 100 END AS diff_pct
FROM (SELECT product_id, SUM(quantity_kg) AS kg FROM supply WHERE market_id = {MARKET} GROUP BY product_id) a
JOIN (SELECT product_id, SUM(quantity_kg) AS kg FROM supply WHERE market_id = {OTHER_MARKET} GROUP BY product_id) b ON a.product_id = b.product_id
LEFT JOIN product ON a.product_id = product.product_id"""))
def market_supply_comparison(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.compare_markets(v.arrivals, v.products, MARKET, OTHER_MARKET, AS_OF, 0)

"""Catalogue, farm-input and hierarchy queries and their oracles."""

from __future__ import annotations


from cosecha.operators import catalog as ops
from cosecha.plans.registry import Registry
from cosecha.plans.views import AS_OF, Views, sql, sql_with

registry = Registry()

#: Parameters of the registered queries.
CODE, SUBGROUP, INPUT, DAYS = "Brand#11", "ECONOMY", 1, 730


@registry.query("J1_departments", sql("SELECT department_id, department_name FROM department"))
def departments(spark, sf_dir):
    return Views(spark, sf_dir).departments.orderBy("department_name")


@registry.query("J1_subcategories", sql("SELECT DISTINCT category_name, subcategory_name FROM product"))
def subcategories(spark, sf_dir):
    return Views(spark, sf_dir).products.select("category_name", "subcategory_name").distinct().orderBy("category_name", "subcategory_name")


@registry.query("J2_search_products", sql("SELECT * FROM product WHERE product_name ILIKE '%gizmo%' ORDER BY product_name, product_id LIMIT 50"))
def search_products(spark, sf_dir):
    return ops.search_products(Views(spark, sf_dir).products, "GIZMO")


@registry.query("J8_located_markets", sql("""
SELECT market_id, market_name, city_name, department_name, CASE WHEN contains(lower(market_name), lower(city_name)) THEN market_name ELSE market_name || ' (' || city_name || ')' END AS label
FROM market LEFT JOIN city ON market.city_id = city.city_id LEFT JOIN department ON city.department_id = department.department_id"""))
def located_markets(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.located_markets(v.markets, v.cities, v.departments)


@registry.query("I14_latest_input_prices", sql(f"""
SELECT input_id, i.department_id, department_name, CAST(price_date AS VARCHAR) AS price_date, CAST(avg_price AS DOUBLE) AS avg_price, presentation
FROM input_prices i JOIN department d ON i.department_id = d.department_id WHERE price_date >= DATE '{AS_OF}' - {DAYS}
QUALIFY ROW_NUMBER() OVER (PARTITION BY input_id ORDER BY price_date DESC, presentation, order_id DESC, line DESC, avg_price DESC) = 1"""))
def latest_input_prices(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.latest_input_prices(v.input_prices, v.departments, AS_OF, DAYS)


@registry.query("I15_latest_prices_by_code", sql(f"""
SELECT department_name, article, brand, presentation, CAST(avg_price AS DOUBLE) AS avg_price, CAST(price_date AS VARCHAR) AS price_date
FROM input_prices i JOIN department d ON i.department_id = d.department_id WHERE cpc_code = '{CODE}'
QUALIFY ROW_NUMBER() OVER (PARTITION BY i.department_id, brand, article, presentation ORDER BY price_date DESC, order_id DESC, line DESC, avg_price DESC) = 1"""))
def latest_prices_by_code(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.latest_by_code(v.input_prices, v.departments, CODE)


@registry.query("I16_latest_prices_by_subgroup", sql_with(
    f"""latest AS (SELECT i.*, department_name FROM input_prices i JOIN department d ON i.department_id = d.department_id WHERE subgroup = '{SUBGROUP}'
QUALIFY ROW_NUMBER() OVER (PARTITION BY input_id, i.department_id, city_id, presentation ORDER BY price_date DESC, order_id DESC, line DESC, avg_price DESC) = 1)""",
    """SELECT department_name, article, COALESCE(city_name, '') AS brand, presentation, CAST(avg_price AS DOUBLE) AS avg_price, CAST(price_date AS VARCHAR) AS price_date
FROM latest LEFT JOIN city ON latest.city_id = city.city_id"""))
def latest_prices_by_subgroup(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.latest_by_subgroup(v.input_prices, v.departments, v.cities, SUBGROUP)


@registry.query("F6_latest_codes", sql("""
SELECT input_id, cpc_code FROM input_prices WHERE cpc_code IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY input_id ORDER BY price_date DESC, cpc_code, order_id DESC) = 1"""))
def latest_codes(spark, sf_dir):
    return ops.latest_codes(Views(spark, sf_dir).input_prices)


@registry.query("J15_input_history", sql(f"""
SELECT department_id, CAST(price_date AS VARCHAR) AS price_date, CAST(SUM(avg_price) AS DOUBLE) / COUNT(avg_price) AS mean_price FROM input_prices WHERE input_id = {INPUT} GROUP BY department_id, price_date"""))
def input_history(spark, sf_dir):
    return ops.input_history(Views(spark, sf_dir).input_prices, INPUT)


@registry.query("I20_classification_tree", sql("""
SELECT category_name AS code, NULL AS parent, 'section' AS level, COUNT(*) AS products FROM product GROUP BY category_name
UNION ALL SELECT category_name || '/' || subcategory_name, category_name, 'group', COUNT(*) FROM product GROUP BY category_name, subcategory_name
UNION ALL SELECT category_name || '/' || subcategory_name || '/' || product_id, category_name || '/' || subcategory_name, 'product', COUNT(*) FROM product GROUP BY category_name, subcategory_name, product_id"""))
def classification_tree(spark, sf_dir):
    return ops.classification_tree(Views(spark, sf_dir).products)


@registry.query("J27_section_tree", sql_with(
    "sizes AS (SELECT COALESCE(category_name, 'Otro') AS category, COALESCE(subcategory_name, 'General') AS subcategory, COUNT(*) AS n FROM product GROUP BY ALL)",
    "SELECT category, CAST(SUM(n) AS BIGINT) AS products, STRING_AGG(subcategory || ':' || n, ',' ORDER BY subcategory || ':' || n) AS subcategories FROM sizes GROUP BY category"))
def section_tree(spark, sf_dir):
    return ops.section_tree(Views(spark, sf_dir).products)


@registry.query("J16_entity_comments", sql_with(
    """names AS (SELECT 'product' AS entity_type, product_id AS entity_id, product_name AS entity_name FROM product UNION ALL SELECT 'market', market_id, market_name FROM market),
remarks AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'product' ELSE 'market' END AS entity_type, conv_id % 50 + 1 AS entity_id, trim(text, ' ') AS content FROM conversations)""",
    "SELECT conv_id, turn, r.entity_type, r.entity_id, entity_name, CAST(length(content) AS BIGINT) AS content_chars FROM remarks r LEFT JOIN names n ON r.entity_type = n.entity_type AND r.entity_id = n.entity_id"))
def entity_comments(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.entity_comments(v.table("conversations"), v.products, v.markets)

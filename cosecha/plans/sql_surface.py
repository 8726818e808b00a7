"""The parameterised queries as SQL table functions over temporary views, for callers that speak SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cosecha.plans.views import AS_OF, Views

_SINCE = "(days <= 0 OR {0} >= date_sub(DATE '{1}', days))"


def _functions(as_of: str) -> dict[str, str]:
    supply, price = _SINCE.format("observation_date", as_of), _SINCE.format("price_date", as_of)
    positive = "coalesce(avg_price, min_price, max_price, 0) > 0"
    twice = "coalesce(avg_price + avg_price, min_price + max_price)"
    mean = f"cast(sum({twice}) AS double) / nullif(count({twice}) * 2, 0)"
    return {
        "market_supply_summary": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (total_kg DOUBLE, num_days BIGINT, oldest_obs DATE, newest_obs DATE)
            RETURN SELECT coalesce(cast(sum(quantity_kg) AS double), 0), count(DISTINCT observation_date), min(observation_date), max(observation_date)
            FROM supply WHERE market_id = wanted AND {supply}""",
        "market_top_products": f"""(wanted BIGINT, days INT DEFAULT 30, k INT DEFAULT 10) RETURNS TABLE (product_id BIGINT, product_name STRING, total_kg DOUBLE)
            RETURN SELECT t.product_id, p.product_name, cast(t.kg AS double) FROM (
              SELECT product_id, kg, row_number() OVER (ORDER BY kg DESC NULLS LAST, product_id) AS place FROM (
                SELECT product_id, sum(quantity_kg) AS kg FROM supply WHERE market_id = wanted AND {supply} GROUP BY product_id)) t
            LEFT JOIN product p ON t.product_id = p.product_id WHERE t.place <= k""",
        "product_supply_by_date": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (observation_date DATE, total_kg DOUBLE)
            RETURN SELECT observation_date, cast(sum(quantity_kg) AS double) FROM supply WHERE product_id = wanted AND {supply} GROUP BY observation_date""",
        "supply_by_department": f"""(days INT DEFAULT 30) RETURNS TABLE (department_id BIGINT, total_kg DOUBLE)
            RETURN SELECT department_id, cast(sum(quantity_kg) AS double) FROM supply JOIN city USING (city_id) WHERE {supply} GROUP BY department_id""",
        "prices_by_department": f"""(days INT DEFAULT 30) RETURNS TABLE (department_id BIGINT, avg_price DOUBLE, observation_count BIGINT)
            RETURN SELECT department_id, {mean}, count(*) FROM prices JOIN city USING (city_id) WHERE {positive} AND {price} GROUP BY department_id""",
        "price_markets_for_product": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (market_id BIGINT)
            RETURN SELECT DISTINCT market_id FROM prices WHERE product_id = wanted AND market_id IS NOT NULL AND {price}""",
        "supply_markets_for_product": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (market_id BIGINT)
            RETURN SELECT DISTINCT market_id FROM supply WHERE product_id = wanted AND market_id IS NOT NULL AND {supply}""",
        "product_presentations": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (presentation_id STRING, units_id STRING)
            RETURN SELECT DISTINCT presentation_id, units_id FROM prices WHERE product_id = wanted AND presentation_id IS NOT NULL AND units_id IS NOT NULL AND {positive} AND {price}""",
    }


def _more_functions(as_of: str) -> dict[str, str]:
    """The functions by origin, for watchlists and for farm inputs."""
    supply, price = _SINCE.format("observation_date", as_of), _SINCE.format("price_date", as_of)
    label = "coalesce(nullif(origin, ''), 'Desconocido')"
    newest = "price_date DESC, order_id DESC, line DESC, avg_price DESC"
    top_origins = """SELECT origin, cast(kg AS double) FROM (SELECT origin, kg, row_number() OVER (ORDER BY kg DESC NULLS LAST, origin) AS place
              FROM (SELECT {label} AS origin, sum(quantity_kg) AS kg FROM supply WHERE {key} = wanted AND {since} GROUP BY 1)) WHERE place <= k"""
    return {
        "market_top_origins": f"(wanted BIGINT, days INT DEFAULT 30, k INT DEFAULT 15) RETURNS TABLE (origin STRING, total_kg DOUBLE) RETURN {top_origins.format(label=label, key='market_id', since=supply)}",
        "product_top_origins": f"(wanted BIGINT, days INT DEFAULT 30, k INT DEFAULT 15) RETURNS TABLE (origin STRING, total_kg DOUBLE) RETURN {top_origins.format(label=label, key='product_id', since=supply)}",
        "product_supply_summary": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (total_kg DOUBLE, num_days BIGINT, oldest_obs DATE, newest_obs DATE)
            RETURN SELECT coalesce(cast(sum(quantity_kg) AS double), 0), count(DISTINCT observation_date), min(observation_date), max(observation_date)
            FROM supply WHERE product_id = wanted AND {supply}""",
        "product_top_destinations": f"""(wanted BIGINT, days INT DEFAULT 30, k INT DEFAULT 15) RETURNS TABLE (market_id BIGINT, market_name STRING, total_kg DOUBLE)
            RETURN SELECT t.market_id, m.market_name, cast(t.kg AS double) FROM (
              SELECT market_id, kg, row_number() OVER (ORDER BY kg DESC NULLS LAST, market_id) AS place FROM (
                SELECT market_id, sum(quantity_kg) AS kg FROM supply WHERE product_id = wanted AND market_id IS NOT NULL AND {supply} GROUP BY market_id)) t
            LEFT JOIN market m ON t.market_id = m.market_id WHERE t.place <= k""",
        "supply_by_department_for_product": f"""(wanted BIGINT, days INT DEFAULT 30) RETURNS TABLE (department_id BIGINT, total_kg DOUBLE)
            RETURN SELECT department_id, cast(sum(quantity_kg) AS double) FROM supply JOIN city USING (city_id) WHERE product_id = wanted AND {supply} GROUP BY department_id""",
        "national_supply_averages": f"""(days INT DEFAULT 30) RETURNS TABLE (product_id BIGINT, avg_kg DOUBLE, market_count BIGINT)
            RETURN SELECT product_id, cast(sum(kg) AS double) / count(*), count(*) FROM (
              SELECT product_id, market_id, sum(quantity_kg) AS kg FROM supply WHERE market_id IS NOT NULL AND {supply} GROUP BY product_id, market_id) GROUP BY product_id""",
        "watchlist_input_prices": f"""(days INT DEFAULT 180) RETURNS TABLE (input_id BIGINT, price_date DATE, avg_price DOUBLE, presentation STRING)
            RETURN SELECT input_id, price_date, cast(avg_price AS double), presentation FROM (
              SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY price_date DESC, presentation NULLS LAST, order_id DESC, line DESC, avg_price DESC) AS place
              FROM input_prices WHERE {price}) WHERE place = 1""",
        "latest_prices_of_code": f"""(wanted STRING) RETURNS TABLE (department_id BIGINT, article STRING, brand STRING, presentation STRING, avg_price DOUBLE, price_date DATE)
            RETURN SELECT department_id, article, brand, presentation, cast(avg_price AS double), price_date FROM (
              SELECT *, row_number() OVER (PARTITION BY department_id, brand, article, presentation ORDER BY {newest}) AS place FROM input_prices WHERE cpc_code = wanted) WHERE place = 1""",
        "latest_prices_of_subgroup": f"""(wanted STRING) RETURNS TABLE (department_id BIGINT, input_id BIGINT, city_id BIGINT, presentation STRING, avg_price DOUBLE, price_date DATE)
            RETURN SELECT department_id, input_id, city_id, presentation, cast(avg_price AS double), price_date FROM (
              SELECT *, row_number() OVER (PARTITION BY input_id, department_id, city_id, presentation ORDER BY {newest}) AS place FROM input_prices WHERE subgroup = wanted) WHERE place = 1""",
    }


def register_scalars(spark: SparkSession) -> list[str]:
    """Scalar functions: the effective price, and the label of an origin that may be missing."""
    functions = {
        "effective_price": "(mean DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN coalesce(mean, (low + high) / 2)",
        "origin_label": "(origin STRING) RETURNS STRING RETURN coalesce(nullif(origin, ''), 'Desconocido')",
    }
    for name, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(functions)


def register_functions(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> list[str]:
    """Create the views and the functions in the session; 0 or fewer days mean all. Returns the functions' names."""
    v = Views(spark, sf_dir)
    tables = {"department": v.departments, "city": v.cities, "market": v.markets, "product": v.products, "prices": v.prices, "supply": v.supply, "input_prices": v.input_prices}
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    functions = _functions(as_of)
    for name, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(functions)


def register_all(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> list[str]:
    """As ``register_functions``, with the functions by origin, for watchlists and inputs, and the scalar ones."""
    names = register_functions(spark, sf_dir, as_of)
    for name, body in (more := _more_functions(as_of)).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return [*names, *more, *register_scalars(spark)]

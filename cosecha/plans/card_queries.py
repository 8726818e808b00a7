"""Queries behind cards, charts, rankings and input screens, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.operators import browse, cards, catalog
from cosecha.plans.price_queries import _COMPARED, _FIRST, _NEWEST, _SINCE, DAYS, MARKET, market_price_comparison
from cosecha.plans.registry import Registry
from cosecha.plans.views import AS_OF, Views, sql, sql_with

registry = Registry()


def _trending(keys: str, where: str) -> str:
    return sql_with(
        f"""priced AS (SELECT *, {_FIRST} AS price FROM prices WHERE {where}),
series AS (SELECT {keys}, FIRST(price ORDER BY price_date, round, order_id, line, price) AS old_p, FIRST(price ORDER BY price_date DESC, round DESC, order_id DESC, line DESC, price DESC) AS new_p, COUNT(*) AS n FROM priced GROUP BY ALL),
changes AS (SELECT *, CAST(new_p AS DOUBLE) AS latest_price, CASE WHEN old_p = 0 THEN 0 ELSE (CAST(new_p AS DOUBLE) - CAST(old_p AS DOUBLE)) / CAST(old_p AS DOUBLE) * 100 END AS change_pct FROM series WHERE n >= 2),
best AS (SELECT * FROM changes QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY ABS(change_pct) DESC, presentation_id) = 1),
top AS (SELECT * FROM best ORDER BY ABS(change_pct) DESC, product_id LIMIT 15),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY SIGN(change_pct) ORDER BY change_pct DESC, product_id) AS u, ROW_NUMBER() OVER (PARTITION BY SIGN(change_pct) ORDER BY change_pct, product_id) AS d FROM top)""",
        "SELECT product_id, presentation_id, latest_price, change_pct, CAST(CASE WHEN change_pct > 0 AND u <= 5 THEN u END AS VARCHAR) AS up, CAST(CASE WHEN change_pct < 0 AND d <= 5 THEN d END AS VARCHAR) AS down FROM ranked")


def _places_as_text(rows):
    return rows.withColumns({c: F.col(c).cast("string") for c in ("up", "down")})


@registry.query("J18_trending_national", _trending("product_id, presentation_id", _SINCE))
def trending_national(spark, sf_dir):
    return _places_as_text(cards.trending(Views(spark, sf_dir).price_lines, AS_OF, DAYS))


@registry.query("J18_trending_at_market", _trending("product_id, presentation_id, market_id", f"{_SINCE} AND market_id = {MARKET}"))
def trending_at_market(spark, sf_dir):
    return _places_as_text(cards.trending(Views(spark, sf_dir).price_lines, AS_OF, DAYS, MARKET))


@registry.query("J18_trending_falls_back", _trending("product_id, presentation_id", _SINCE))
def trending_falls_back(spark, sf_dir):
    return _places_as_text(cards.trending(Views(spark, sf_dir).price_lines, AS_OF, DAYS, market=-1))


_DAY = """SELECT product_id, MAX(price_date) AS d, COALESCE(CAST(SUM(lo) AS DOUBLE) / NULLIF(COUNT(lo), 0), 0) AS low, COALESCE(CAST(SUM(hi) AS DOUBLE) / NULLIF(COUNT(hi), 0), 0) AS high FROM
  (SELECT product_id, price_date, CASE WHEN COALESCE(min_price, avg_price) > 0 THEN COALESCE(min_price, avg_price) END AS lo, CASE WHEN COALESCE(max_price, avg_price) > 0 THEN COALESCE(max_price, avg_price) END AS hi
   FROM {rows} QUALIFY price_date = MAX(price_date) OVER (PARTITION BY product_id)) GROUP BY product_id"""


def _cards(market: int | None, one_presentation: bool) -> str:
    same = "AND prices.presentation_id IS NOT DISTINCT FROM c.presentation_id AND prices.units_id IS NOT DISTINCT FROM c.units_id" if one_presentation else ""
    here = f"market_id = {market}" if market is not None else "FALSE"
    last = f"SELECT product_id, CASE WHEN avg_price <> 0 THEN CAST(avg_price AS DOUBLE) ELSE (CAST(min_price AS DOUBLE) + CAST(max_price AS DOUBLE)) / 2 END AS before FROM older WHERE {here} QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) = 1"
    before = last if market is not None else f"SELECT product_id, (low + high) / 2 AS before FROM ({_DAY.format(rows='older')})"
    return sql_with(
        f"""counts AS (SELECT product_id, presentation_id, units_id, COUNT(*) AS n, MAX((price_date, round, order_id, line)) AS newest FROM prices WHERE {_SINCE} GROUP BY ALL),
common AS (SELECT * FROM counts QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY n DESC, newest DESC, presentation_id, units_id) = 1),
bucket AS (SELECT prices.* FROM prices JOIN common c ON prices.product_id = c.product_id {same} WHERE {_SINCE}),
national AS ({_DAY.format(rows='bucket')}),
own AS (SELECT product_id, price_date AS d, CAST(COALESCE(min_price, avg_price, 0) AS DOUBLE) AS low, CAST(COALESCE(max_price, avg_price, 0) AS DOUBLE) AS high FROM bucket WHERE {here} QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) = 1),
chosen AS (SELECT n.product_id, CASE WHEN o.d IS NULL THEN 'national' ELSE 'market' END AS scope, COALESCE(o.d, n.d) AS d, CASE WHEN o.d IS NULL THEN n.low ELSE o.low END AS low, CASE WHEN o.d IS NULL THEN n.high ELSE o.high END AS high FROM national n LEFT JOIN own o USING (product_id)),
older AS (SELECT b.* FROM bucket b JOIN chosen USING (product_id) WHERE b.price_date <= chosen.d - 7),
before AS ({before})""",
        """SELECT product_id, c.presentation_id AS common_presentation_id, c.units_id AS common_units_id, scope, CAST(d AS VARCHAR) AS price_date, low, high,
CASE WHEN before > 0 AND (low + high) / 2 > 0 THEN ((low + high) / 2 - before) / before * 100 END AS week_change_pct FROM chosen JOIN common c USING (product_id) LEFT JOIN before USING (product_id)""")


@registry.query("J19_price_cards", _cards(MARKET, True))
def price_cards(spark, sf_dir):
    return cards.price_cards(Views(spark, sf_dir).price_lines, AS_OF, DAYS, MARKET)


@registry.query("J19_national_price_cards", _cards(None, True))
def national_price_cards(spark, sf_dir):
    return cards.price_cards(Views(spark, sf_dir).price_lines, AS_OF, DAYS)


@registry.query("J20_mixed_price_cards", _cards(None, False))
def mixed_price_cards(spark, sf_dir):
    return cards.price_cards(Views(spark, sf_dir).price_lines, AS_OF, DAYS, one_presentation=False)


@registry.query("J21_chart_series", sql("""
SELECT product_id, CAST(price_date AS VARCHAR) AS price_date, CAST(MIN(lo) AS DOUBLE) AS low, CAST(MAX(hi) AS DOUBLE) AS high, CAST(SUM(lo + hi) AS DOUBLE) / (COUNT(*) * 2) AS mean FROM (
  SELECT product_id, price_date, CASE WHEN min_price > 0 THEN min_price ELSE COALESCE(avg_price, max_price) END AS lo, CASE WHEN max_price > 0 THEN max_price ELSE COALESCE(avg_price, min_price) END AS hi FROM prices)
WHERE lo IS NOT NULL AND hi IS NOT NULL AND (lo > 0 OR hi > 0) GROUP BY ALL"""))
def chart_series(spark, sf_dir):
    return cards.chart_series(Views(spark, sf_dir).price_lines, AS_OF)


@registry.query("E19_mean_differences", sql_with(_COMPARED, """
SELECT category, subcategory, CAST(GROUPING(category, subcategory) AS INTEGER) AS level, ROUND(AVG(diff_pct), 6) AS mean_diff_pct, COUNT(diff_pct) AS matched, COUNT(*) AS series
FROM (SELECT COALESCE(category_name, 'Otro') AS category, COALESCE(subcategory_name, 'General') AS subcategory, diff_pct FROM compared) GROUP BY ROLLUP (category, subcategory)"""))
def mean_differences(spark, sf_dir):
    return cards.comparison_means(market_price_comparison(spark, sf_dir))


_LOW = "CASE WHEN avg_price <> 0 THEN avg_price WHEN min_price <> 0 THEN min_price ELSE 0 END"


@registry.query("F8_market_ranking", sql_with(
    f"latest AS (SELECT product_id, market_id, price_date, {_LOW} AS price FROM prices WHERE {_SINCE} AND presentation_id = 'N' QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, market_id ORDER BY {_NEWEST}) = 1)",
    "SELECT product_id, CAST(market_id AS VARCHAR) AS market_id, CAST(price_date AS VARCHAR) AS price_date, CAST(price AS DOUBLE) AS price, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY price, market_id NULLS LAST) AS place FROM latest"))
def market_ranking(spark, sf_dir):
    rows = cards.market_ranking(Views(spark, sf_dir).price_lines, AS_OF, DAYS, presentation_id="N")
    return rows.withColumn("market_id", F.col("market_id").cast("string"))


@registry.query("E24_mean_lines", sql("""
SELECT product_id, CAST(SUM(price) AS DOUBLE) / COUNT(*) AS mean_line, COUNT(*) AS days FROM (SELECT product_id, price_date, MAX(max_price) AS price FROM prices WHERE max_price IS NOT NULL GROUP BY ALL) GROUP BY product_id"""))
def mean_lines(spark, sf_dir):
    return cards.mean_gaps(Views(spark, sf_dir).price_lines, AS_OF, 0)


@registry.query("E22_top_supply_total", sql("""
SELECT CAST(SUM(kg) AS DOUBLE) AS total, COUNT(*) AS members FROM (SELECT product_id, SUM(quantity_kg) AS kg FROM supply GROUP BY product_id ORDER BY kg DESC NULLS LAST, product_id LIMIT 10)"""))
def top_supply_total(spark, sf_dir):
    totals = Views(spark, sf_dir).arrivals.groupBy("product_id").agg(F.sum("quantity_kg").alias("kg"))
    return cards.top_sum(totals, "kg", "product_id")


@registry.query("J23_input_headers", sql_with(
    """counts AS (SELECT input_id, presentation, COUNT(*) AS n, MAX(price_date) AS newest FROM input_prices GROUP BY ALL),
common AS (SELECT input_id, presentation FROM counts QUALIFY ROW_NUMBER() OVER (PARTITION BY input_id ORDER BY n DESC, newest DESC, presentation) = 1)""",
    """SELECT input_id, c.presentation, CAST(avg_price AS DOUBLE) AS avg_price, CAST(price_date AS VARCHAR) AS price_date, department_id FROM input_prices p JOIN common c USING (input_id) WHERE p.presentation = c.presentation
QUALIFY ROW_NUMBER() OVER (PARTITION BY input_id ORDER BY price_date DESC, order_id DESC, line DESC, avg_price DESC) = 1"""))
def input_headers(spark, sf_dir):
    return cards.input_headers(Views(spark, sf_dir).input_prices)


@registry.query("J23_input_series", sql(f"""
SELECT input_id, level, place_id, CAST(price_date AS VARCHAR) AS price_date, CAST(SUM(avg_price) AS DOUBLE) / COUNT(*) AS value FROM (
  SELECT *, CASE WHEN cities THEN 'city' ELSE 'department' END AS level, CASE WHEN cities THEN city_id ELSE department_id END AS place_id FROM (
    SELECT *, BOOL_OR(city_id IS NOT NULL) OVER (PARTITION BY input_id) AS cities FROM input_prices WHERE {_SINCE} AND presentation = 'N'))
WHERE avg_price <> 0 AND place_id IS NOT NULL GROUP BY ALL"""))
def input_series(spark, sf_dir):
    return cards.input_series(Views(spark, sf_dir).input_prices, AS_OF, DAYS, "N")


def _inputs(spark, sf_dir):
    code = F.when(F.col("product_id") % 4 != 0, F.concat(F.lit("0"), F.col("subcategory_name")))
    return Views(spark, sf_dir).products.withColumn("cpc_code", code)


_INPUTS = "inputs AS (SELECT *, CASE WHEN product_id % 4 <> 0 THEN '0' || subcategory_name END AS cpc_code FROM product)"


@registry.query("G7_codes_before_none", sql_with(_INPUTS, "SELECT category_name, cpc_code, product_id, ROW_NUMBER() OVER (PARTITION BY category_name ORDER BY cpc_code NULLS LAST, product_name, product_id) AS place FROM inputs"))
def codes_before_none(spark, sf_dir):
    return cards.code_order(_inputs(spark, sf_dir))


@registry.query("J14_input_page", sql_with(_INPUTS, "SELECT product_id, product_name, COALESCE('T' || cpc_code, '') AS cpc_title FROM inputs WHERE product_name ILIKE '%a%' ORDER BY product_name, product_id LIMIT 40 OFFSET 20"))
def input_page(spark, sf_dir):
    found = catalog.search_products(_inputs(spark, sf_dir), search="a", limit=None)
    titles = _inputs(spark, sf_dir).select("cpc_code").filter("cpc_code is not null").distinct().withColumn("title", F.concat(F.lit("T"), "cpc_code"))
    rows = cards.page(found, [F.asc("product_name"), F.asc("product_id")], 20, 40)
    return rows.join(titles, "cpc_code", "left").select("product_id", "product_name", F.coalesce("title", F.lit("")).alias("cpc_title"))


@registry.query("C11_single_input", sql("SELECT product_id, product_name, category_name, subcategory_name FROM product WHERE product_id = 7"))
def single_input(spark, sf_dir):
    return cards.single(Views(spark, sf_dir).products.filter("product_id = 7"))


@registry.query("C21_picked_markets", sql_with("named AS (SELECT market_id, market_name, city_name FROM market LEFT JOIN city USING (city_id))", "SELECT * FROM named WHERE contains(lower(market_name), '01') OR contains(lower(COALESCE(city_name, '')), '01')"))
def picked_markets(spark, sf_dir):
    v = Views(spark, sf_dir)
    named = v.markets.join(v.cities, "city_id", "left").select("market_id", "market_name", "city_name")
    return cards.matching_names(named, "market_name", "city_name", "01")


@registry.query("J1_lists", sql("""
SELECT 'category' AS kind, category_name AS name, NULL AS parent FROM product GROUP BY ALL UNION ALL SELECT 'subcategory', subcategory_name, category_name FROM product GROUP BY ALL
UNION ALL SELECT 'department', department_name, NULL FROM department UNION ALL SELECT 'input_group', subgroup, NULL FROM input_prices GROUP BY ALL UNION ALL SELECT 'input_subgroup', cpc_code, subgroup FROM input_prices GROUP BY ALL"""))
def lists(spark, sf_dir):
    v = Views(spark, sf_dir)
    return catalog.named_lists(v.products, v.departments, v.input_prices)


@registry.query("J27_market_tree", sql("""
SELECT COALESCE(department_name, 'Otro') AS section, COUNT(*) AS members, STRING_AGG(market_name, ',' ORDER BY market_name) AS names FROM market LEFT JOIN city USING (city_id) LEFT JOIN department USING (department_id) GROUP BY ALL"""))
def market_tree(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.markets.join(v.cities, "city_id", "left").join(v.departments, "department_id", "left")
    return catalog.sections(rows, "department_name", "market_name")


@registry.query("J27_input_tree", sql_with(_INPUTS, """
SELECT *, ROW_NUMBER() OVER (PARTITION BY input_group, subgroup ORDER BY cpc_code NULLS LAST) AS place FROM (
  SELECT category_name AS input_group, COALESCE(subcategory_name, 'General') AS subgroup, cpc_code, COUNT(*) AS members FROM inputs GROUP BY ALL)"""))
def input_tree(spark, sf_dir):
    return catalog.input_tree(_inputs(spark, sf_dir))


@registry.query("D8_places_twice", sql("""
SELECT o_orderkey, f.city_name AS from_city, t.city_name AS to_city FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN city f ON c_nationkey = f.city_id LEFT JOIN city t ON (c_nationkey + o_orderkey) % 30 = t.city_id"""))
def places_twice(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", F.col("c_nationkey").alias("from_id"), ((F.col("c_nationkey") + F.col("o_orderkey")) % 30).alias("to_id"))
    return catalog.named_twice(rows, v.cities, "city_id", "city_name", "from_id", "to_id").select("o_orderkey", F.col("from_name").alias("from_city"), F.col("to_name").alias("to_city"))


@registry.query("J15_city_history", sql("SELECT input_id, city_id, CAST(price_date AS VARCHAR) AS price_date, CAST(SUM(avg_price) AS DOUBLE) / COUNT(*) AS mean_price FROM input_prices WHERE city_id IS NOT NULL GROUP BY ALL"))
def city_history(spark, sf_dir):
    return catalog.city_history(Views(spark, sf_dir).input_prices)


@registry.query("D19_comments_on_all_kinds", sql_with(
    """rows_ AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'market' ELSE 'insumo' END AS entity_type, conv_id % 50 + 1 AS entity_id, trim(text, ' ') AS content FROM conversations),
names AS (SELECT 'product' AS entity_type, product_id AS entity_id, product_name AS entity_name FROM product UNION ALL SELECT 'market', market_id, market_name FROM market UNION ALL SELECT DISTINCT 'insumo', product_id, 'Insumo ' || product_name FROM product)""",
    "SELECT conv_id, turn, entity_type, entity_id, entity_name, length(content) AS content_chars FROM rows_ LEFT JOIN names USING (entity_type, entity_id) ORDER BY conv_id DESC, turn DESC LIMIT 50"))
def comments_on_all_kinds(spark, sf_dir):
    v = Views(spark, sf_dir)
    kind = F.get(F.array(F.lit("product"), F.lit("market"), F.lit("insumo")), (F.col("conv_id") % 3).cast("int"))
    rows = v.table("conversations").select("conv_id", "turn", kind.alias("entity_type"), (F.col("conv_id") % 50 + 1).alias("entity_id"), F.trim("text").alias("content"))
    inputs = v.products.select("product_id", F.concat(F.lit("Insumo "), "product_name").alias("name"))
    named = catalog.named_entities(rows, {"product": v.products.select("product_id", "product_name"), "market": v.markets.select("market_id", "market_name"), "insumo": inputs})
    newest = cards.page(named, [F.desc("conv_id"), F.desc("turn")], 0, 50)
    return newest.select("conv_id", "turn", "entity_type", "entity_id", "entity_name", F.length("content").cast("long").alias("content_chars"))


@registry.query("J4_recent_market_prices", sql(f"""
SELECT product_id, market_name, presentation_id, units_id, CAST(price_date AS VARCHAR) AS price_date, round, CAST(min_price AS DOUBLE) AS min_price, CAST(max_price AS DOUBLE) AS max_price, CAST(avg_price AS DOUBLE) AS avg_price
FROM prices LEFT JOIN market USING (market_id) WHERE product_id = 1 AND price_date >= DATE '{AS_OF}' - 1400 ORDER BY {_NEWEST} LIMIT 100"""))
def recent_market_prices(spark, sf_dir):
    v = Views(spark, sf_dir)
    return browse.price_series(v.price_lines, v.markets, AS_OF, 1400, limit=100, product_id=1)


@registry.query("D9_located_places", sql("SELECT city_id, CASE WHEN city_id % 3 <> 0 AND city_id % 4 <> 0 THEN CAST(city_id % 3 AS DOUBLE) END AS longitude, CASE WHEN city_id % 3 <> 0 AND city_id % 4 <> 0 THEN CAST(city_id % 4 AS DOUBLE) END AS latitude FROM city"))
def located_places(spark, sf_dir):
    from cosecha.operators.dimensions import located

    cities = Views(spark, sf_dir).cities.select("city_id")
    gazetteer = cities.select("city_id", (F.col("city_id") % 3).cast("double").alias("longitude"), (F.col("city_id") % 4).cast("double").alias("latitude"))
    return located(cities, gazetteer, "city_id")


@registry.query("L19_percent_changes", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_totalprice - o_orderkey % 5) / (o_orderkey % 5) * 100 END AS change FROM orders")
def percent_changes(spark, sf_dir):
    from cosecha.functions.columns import percent_change

    old = (F.col("o_orderkey") % 5).cast("double")
    return Views(spark, sf_dir).table("orders").select("o_orderkey", percent_change(old, F.col("o_totalprice")).alias("change"))

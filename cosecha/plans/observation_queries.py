"""Queries that build dimensions and observations from staged rows, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.functions.text import MONTHS, norm_key
from cosecha.operators import observations as ops
from cosecha.operators import quality
from cosecha.plans.golden_queries import _every_file, _grid
from cosecha.plans.registry import Registry
from cosecha.plans.sql_surface import register_scalars
from cosecha.plans.views import Views
from cosecha.sources import layouts, sinks
from cosecha.sources.workbooks import date_cell, number_cell, text_cell

registry = Registry()

_STAGED = """
staged AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS price_date,
    CASE WHEN l_orderkey % 29 = 0 THEN 'zz' || p_name WHEN l_orderkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS product,
    CASE WHEN l_orderkey % 31 = 0 THEN 'Nowhere' ELSE n_name END AS city,
    CASE WHEN l_orderkey % 19 = 0 THEN '' WHEN l_orderkey % 23 = 0 THEN 'unknown market' ELSE s_name END AS market,
    CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE l_returnflag END AS presentation, l_linestatus AS units, p_type AS category, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS subcategory
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_ALIASES = """
product_alias AS (SELECT raw_value, MIN(p_partkey) AS product_id, MIN(p_brand) AS subcategory_id, MIN(p_type) AS category_id FROM (SELECT p_name AS raw_value, * FROM part UNION ALL SELECT upper(p_name), * FROM part) GROUP BY 1),
market_alias AS (SELECT s_name AS raw_value, MIN(s_suppkey) AS id FROM supplier GROUP BY 1),
kept AS (SELECT s.*, p.product_id, p.subcategory_id, p.category_id, n_nationkey AS city_id, n_regionkey AS department_id, COALESCE(m.id, 1000 + n_nationkey) AS market_id,
    CASE WHEN presentation <> '' THEN presentation || '!' END AS presentation_id, units || '!' AS units_id
  FROM staged s JOIN product_alias p ON product = p.raw_value JOIN nation ON city = n_name LEFT JOIN market_alias m ON market = m.raw_value)"""


def _staged(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("l_orderkey")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("price_date"),
        F.when(key % 29 == 0, F.concat(F.lit("zz"), "p_name")).when(key % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("product"),
        F.when(key % 31 == 0, "Nowhere").otherwise(F.col("n_name")).alias("city"),
        F.when(key % 19 == 0, "").when(key % 23 == 0, "unknown market").otherwise(F.col("s_name")).alias("market"),
        F.when(key % 7 == 0, "").otherwise(F.col("l_returnflag")).alias("presentation"),
        F.col("l_linestatus").alias("units"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.col("p_brand")).alias("subcategory"),
    )


def _aliases(spark, sf_dir):
    v = Views(spark, sf_dir)
    part, nation = v.table("part"), v.table("nation")
    keys = [F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("subcategory_id"), F.col("p_type").alias("category_id")]
    products = part.select(F.col("p_name").alias("raw_value"), *keys).unionByName(part.select(F.upper("p_name").alias("raw_value"), *keys))
    cities = nation.select(F.col("n_name").alias("raw_value"), F.col("n_nationkey").alias("city_id"), F.col("n_regionkey").alias("department_id"))
    # An alias of the empty text must not be found.
    empty = spark.createDataFrame([("", -1)], "raw_value string, id long")
    markets = v.table("supplier").select(F.col("s_name").alias("raw_value"), F.col("s_suppkey").alias("id")).unionByName(empty)
    marked = lambda c: v.table("lineitem").select(F.col(c).alias("raw_value"), F.concat(c, F.lit("!")).alias("id")).distinct()
    presentations = marked("l_returnflag").unionByName(empty.select("raw_value", F.col("id").cast("string").alias("id")))
    own = nation.select(F.col("n_nationkey").alias("city_id"), F.explode(F.array(F.col("n_nationkey") + 2000, F.col("n_nationkey") + 1000)).alias("market_id"))
    return products, cities, markets, presentations, marked("l_linestatus"), own


@registry.query("D1_observations", f"WITH {_STAGED}, {_ALIASES} SELECT l_orderkey, l_linenumber, product_id, subcategory_id, category_id, city_id, department_id, market_id, presentation_id, units_id FROM kept")
def observations(spark, sf_dir):
    rows = ops.observations(_staged(spark, sf_dir), *_aliases(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "product_id", "subcategory_id", "category_id", "city_id", "department_id", "market_id", "presentation_id", "units_id")


@registry.query("M4_monthly_totals", f"""WITH {_STAGED}, {_ALIASES}, total AS (SELECT strftime(price_date, '%Y-%m') AS month, COUNT(*) AS staged FROM staged GROUP BY 1), used AS (SELECT strftime(price_date, '%Y-%m') AS month, COUNT(*) AS kept FROM kept GROUP BY 1)
SELECT month, staged, COALESCE(kept, 0) AS kept, staged - COALESCE(kept, 0) AS skipped FROM total LEFT JOIN used USING (month)""")
def monthly_totals(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    return ops.monthly_totals(staged, ops.observations(staged, *_aliases(spark, sf_dir)), "price_date")


@registry.query("J37_alias_gap_report", f"""WITH {_STAGED}, {_ALIASES}, marked AS (SELECT s.*, product NOT IN (SELECT raw_value FROM product_alias) AS a, city NOT IN (SELECT n_name FROM nation) AS b FROM staged s)
SELECT 'product' AS field, product AS raw_value, COUNT(*) AS rows FROM marked WHERE a GROUP BY ALL UNION ALL SELECT 'city', city, COUNT(*) FROM marked WHERE b GROUP BY ALL UNION ALL SELECT 'skipped', '', COUNT(*) FROM marked WHERE a OR b""")
def alias_gap_report(spark, sf_dir):
    products, cities, *_ = _aliases(spark, sf_dir)
    return ops.alias_gaps(_staged(spark, sf_dir), {"product": products, "city": cities})


@registry.query("M1_city_departments", """
WITH city AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'Á' || lower(n_name) ELSE lower(n_name) END AS city, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT city, CASE k % 4 WHEN 3 THEN 'Desconocido' WHEN 2 THEN 'over ' || r_name ELSE r_name END AS department, CASE k % 4 WHEN 0 THEN 'plain_name' WHEN 1 THEN 'name' WHEN 2 THEN 'override' ELSE 'none' END AS found_by FROM city""")
def city_departments(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("k", F.col("n_nationkey") % 4)
    cities = rows.select(F.when(F.col("k") == 0, F.concat(F.lit("Á"), F.lower("n_name"))).otherwise(F.lower("n_name")).alias("city"))
    known = F.when(F.col("k") == 0, F.concat(F.lit("A"), F.upper("n_name"))).otherwise(F.upper("n_name"))
    gazetteer = rows.filter("k < 2").select(known.alias("municipality"), F.col("r_name").alias("department"))
    overrides = rows.filter("k = 2").select(F.lower("n_name").alias("municipality"), F.concat(F.lit("over "), "r_name").alias("department"))
    return ops.departments_of(cities, gazetteer, overrides)


@registry.query("M1_city_markets", f"""WITH {_STAGED}, raw AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN city ELSE '  ' || city || ' x' END AS city, market FROM staged),
named AS (SELECT trim(city, ' ') AS city, market, COUNT(*) AS n FROM raw WHERE market <> '' GROUP BY ALL),
best AS (SELECT city, market FROM named QUALIFY ROW_NUMBER() OVER (PARTITION BY market ORDER BY n DESC, city) = 1)
SELECT city, market FROM best UNION SELECT trim(city, ' '), 'Mercado municipal de ' || trim(city, ' ') FROM raw WHERE trim(city, ' ') <> 'Nowhere'""")
def city_markets(spark, sf_dir):
    rows = _staged(spark, sf_dir).select(F.when(F.col("l_orderkey") % 3 == 0, F.col("city")).otherwise(F.concat(F.lit("  "), "city", F.lit(" x"))).alias("city"), "market")
    known = ops.aliased(rows, "city")
    found = ops.markets_of_cities(rows, known, ops.aliased(rows, "market"))
    # The place that is none has no market of its own.
    return found.filter("market != 'Mercado municipal de Nowhere'")


@registry.query("C17_junk_and_merges", "SELECT DISTINCT n_name AS raw_value, CASE WHEN n_nationkey % 5 = 0 THEN 'One' ELSE n_name END AS name FROM nation")
def junk_and_merges(spark, sf_dir):
    nation = Views(spark, sf_dir).table("nation")
    junk = spark.createDataFrame([(ops.JUNK_CITIES[0],), ("",), (None,)], "city string")
    merges = nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("raw_value"), F.lit("One").alias("name"))
    return ops.aliased(nation.select(F.col("n_name").alias("city")).unionByName(junk), "city", merges, ops.JUNK_CITIES)


_TAXONOMY = f"""WITH {_STAGED}, types AS (SELECT DISTINCT p_type FROM part WHERE p_type <> (SELECT MAX(p_type) FROM part)),
known AS (SELECT 'C ' || category AS c, CASE WHEN subcategory = '' THEN 'General (C ' || category || ')' ELSE subcategory END AS part, trim(product, ' ') AS product FROM staged JOIN types ON category = p_type),
parts AS (SELECT part, c, COUNT(*) AS n FROM known WHERE NOT starts_with(part, 'General (') GROUP BY ALL)"""


def _taxonomy(spark, sf_dir):
    types = Views(spark, sf_dir).table("part").select("p_type").distinct()
    last = types.agg(F.max("p_type").alias("last"))
    known = types.join(last, F.col("p_type") == F.col("last"), "left_anti")
    return ops.taxonomy(_staged(spark, sf_dir), known.select(F.col("p_type").alias("raw_value"), F.concat(F.lit("C "), "p_type").alias("name")))


@registry.query("M2_subcategories", _TAXONOMY + """ SELECT part AS subcategory, c AS category FROM parts QUALIFY ROW_NUMBER() OVER (PARTITION BY part ORDER BY n DESC, c) = 1
UNION ALL SELECT 'General (C ' || p_type || ')', 'C ' || p_type FROM types""")
def subcategories(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[0]


@registry.query("M2_products", _TAXONOMY + ", counts AS (SELECT product, part, COUNT(*) AS n FROM known GROUP BY ALL) SELECT product, part AS subcategory FROM counts QUALIFY ROW_NUMBER() OVER (PARTITION BY product ORDER BY n DESC, part) = 1")
def products(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[1]


_INPUTS = [
    (1, "Urea granulada 46%", "a", "01"), (2, "Cal dolomita x 50 kg", "a", "02"), (3, "Urea granulado", "a", None), (4, "Zeolita", "a", None), (5, "Cal", "a", "02"),
    (6, "Vacuna aftosa", "b", "09"), (7, "Otra cosa", "b", None), (8, "Sin par", "c", None),
]


@registry.query("M12_backfilled_codes", "SELECT c_custkey * 10 + v.k AS input_id, v.code, v.found_by FROM customer CROSS JOIN (VALUES (3, '01', 'name-match'), (4, '02', 'subgroup-mode'), (7, '09', 'single-code')) v(k, code, found_by)")
def backfilled_codes(spark, sf_dir):
    rows = _grid(spark, sf_dir, _INPUTS, "k long, name string, part string, code string")
    inputs = rows.select((F.col("file") * 10 + F.col("k")).alias("input_id"), "name", F.concat_ws("/", F.col("file").cast("string"), "part").alias("subgroup"), "code")
    return ops.backfilled_codes(inputs)


def _gazetteer(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return rows.select(code("r_regionkey", 2).alias("department_code"), F.col("r_name").alias("department"), code("n_nationkey", 5).alias("municipality_code"), F.col("n_name").alias("municipality"))


@registry.query("M14_departments", "SELECT DISTINCT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS code, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def gazetteer_departments(spark, sf_dir):
    return ops.gazetteer_tables(_gazetteer(spark, sf_dir))[0]


@registry.query("M14_municipalities", "SELECT DISTINCT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, n_name AS name, lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS department_code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def gazetteer_municipalities(spark, sf_dir):
    return ops.gazetteer_tables(_gazetteer(spark, sf_dir))[1]


def _renamed(spark, sf_dir):
    supplier = Views(spark, sf_dir).table("supplier")
    members = supplier.select(F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("name"))
    names = supplier.filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("old"), F.concat(F.lit("New "), "s_name").alias("new"))
    aliases = supplier.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("raw_value"), F.col("s_suppkey").alias("member_id"))
    return ops.renamed(members, aliases, names)


@registry.query("M15_renamed_members", "SELECT s_suppkey AS member_id, CASE WHEN s_suppkey % 3 = 0 THEN 'New ' || s_name ELSE s_name END AS name FROM supplier")
def renamed_members(spark, sf_dir):
    return _renamed(spark, sf_dir)[0]


@registry.query("M15_old_names_as_aliases", "SELECT s_name AS raw_value, s_suppkey AS member_id FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def old_names_as_aliases(spark, sf_dir):
    return _renamed(spark, sf_dir)[1]


@registry.query("C9_own_named_markets", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Mercado municipal de ' || s_name ELSE s_name END AS name FROM supplier WHERE s_suppkey % 4 = 0")
def own_named_markets(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit(ops.OWN_MARKET), "s_name")).otherwise(F.col("s_name"))
    return ops.own_named(Views(spark, sf_dir).table("supplier").select("s_suppkey", name.alias("name")), "name")


_ERRORS = """errors AS (SELECT event_id AS error_id, CASE WHEN event_id % 11 = 0 THEN 'database_error' ELSE event_type END AS error_type, CASE WHEN event_id % 7 = 0 THEN 'Rate LIMIT reached' ELSE props END AS message,
  user_id AS source, ts AS created_at, value > 60 AS resolved, user_id % 50 AS download_id, user_id % 70 AS document_id FROM events),
lasting AS (SELECT * FROM errors WHERE NOT resolved AND error_type <> 'database_error' AND NOT contains(lower(message), 'rate limit') AND source NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0))"""


def _errors(spark, sf_dir):
    key = F.col("event_id")
    return Views(spark, sf_dir).table("events").select(
        key.alias("error_id"),
        F.when(key % 11 == 0, "database_error").otherwise(F.col("event_type")).alias("error_type"),
        F.when(key % 7 == 0, "Rate LIMIT reached").otherwise(F.col("props")).alias("message"),
        F.col("user_id").alias("source"),
        F.col("ts").alias("created_at"),
        (F.col("value") > 60).alias("resolved"),
        (F.col("user_id") % 50).alias("download_id"),
        (F.col("user_id") % 70).alias("document_id"),
    )


def _done(spark, sf_dir):
    return Views(spark, sf_dir).table("customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("source"))


@registry.query("D13_error_context", f"WITH {_ERRORS} SELECT error_id, error_type, c_name AS file, s_name AS document FROM lasting LEFT JOIN customer ON download_id = c_custkey LEFT JOIN supplier ON document_id = s_suppkey")
def error_context(spark, sf_dir):
    v = Views(spark, sf_dir)
    downloads = v.table("customer").select(F.col("c_custkey").alias("download_id"), F.col("c_name").alias("file"))
    documents = v.table("supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("document"))
    found = ops.error_context(_errors(spark, sf_dir), downloads, documents, _done(spark, sf_dir), quality.transient(F.col("error_type"), F.col("message")))
    return found.select("error_id", "error_type", "file", "document")


@registry.query("J36_lasting_errors", f"""WITH {_ERRORS}, sizes AS (SELECT error_type, COUNT(*) AS errors, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, error_type) AS type_place FROM lasting GROUP BY 1)
SELECT error_type, errors, place, error_id, source, type_place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY created_at DESC, error_id DESC) AS place FROM lasting) JOIN sizes USING (error_type) WHERE place <= 50""")
def lasting_errors(spark, sf_dir):
    return quality.lasting_errors(_errors(spark, sf_dir), _done(spark, sf_dir))


@registry.query("J38_snapshot_groups", """WITH marked AS (SELECT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ж' ELSE '' END AS norm_key, p_partkey % 3 <> 0 AS old FROM part WHERE p_partkey % 11 <> 0),
groups_ AS (SELECT norm_key, COUNT(*) FILTER (old) AS old_members, COUNT(*) FILTER (NOT old) AS new_members FROM marked GROUP BY 1)
SELECT norm_key, CASE WHEN old_members > 0 THEN 'NEW+EXISTING' ELSE 'NEW+NEW' END AS kind, old_members, new_members FROM groups_ WHERE new_members > 0 AND old_members + new_members > 1""")
def snapshot_groups(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " - Ж?").otherwise(""))
    after = Views(spark, sf_dir).table("part").select(F.col("p_partkey").alias("member_id"), F.when(F.col("p_partkey") % 11 != 0, name).otherwise("¿?").alias("name"))
    return ops.snapshot_groups(after.filter("member_id % 3 != 0"), after, norm_key(F.col("name")))


@registry.query("H2_new_members", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def new_members(spark, sf_dir):
    after = Views(spark, sf_dir).table("part").select("p_partkey")
    return quality.new_since(after.filter("p_partkey % 3 != 0"), after, "p_partkey")


@registry.query("N_retry_queue", f"""WITH {_ERRORS}, tried AS (SELECT error_id, source, CAST(error_id % 4 AS INTEGER) AS n, resolved, source % 4 = 0 AND source IN (SELECT c_custkey FROM customer) AS good FROM errors)
SELECT error_id, source, CAST(n + CASE WHEN resolved THEN 0 ELSE 1 END AS INTEGER) AS retry_count, resolved OR good AS resolved, NOT (resolved OR good) AND n + CASE WHEN resolved THEN 0 ELSE 1 END < 3 AS queued FROM tried""")
def retry_queue(spark, sf_dir):
    errors = _errors(spark, sf_dir).select("error_id", "source", (F.col("error_id") % 4).cast("int").alias("retry_count"), "resolved")
    good = Views(spark, sf_dir).table("customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("source"))
    return ops.retried(errors, good).select("error_id", "source", "retry_count", "resolved", "queued")


@registry.query("A28_pending_documents", "SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders WHERE o_orderstatus <> 'F'")
def pending_documents(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date").cast("string"))
    ledger = Views(spark, sf_dir).table("orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "F").alias("status"), date.alias("date"))
    return ops.pending(ledger).select("document_id", "date")


@registry.query("E12_table_summary", "SELECT 'nation' AS table_name, 3 AS columns, COUNT(*) AS rows FROM nation UNION ALL SELECT 'region', 2, COUNT(*) FROM region UNION ALL SELECT 'supplier', 4, COUNT(*) FROM supplier")
def table_summary(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ops.table_summary({name: v.table(name) for name in ("nation", "region", "supplier")})


@registry.query("A7_freshness", """SELECT o_orderkey AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'fresh' WHEN o_orderkey % 3 = 0 THEN 'stale' WHEN o_orderkey % 2 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM orders""")
def freshness(spark, sf_dir):
    from cosecha.sources.links import freshness as state

    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    orders = Views(spark, sf_dir).table("orders")
    stored = F.when(key % 3 == 0, "no date").otherwise(day.cast("string"))
    ledger = orders.filter("o_orderkey % 5 != 0").select(key.alias("url"), stored.alias("download_date"))
    headers = orders.filter("o_orderkey % 7 != 0 or o_orderkey % 5 = 0").select(key.alias("url"), F.when(key % 2 == 0, F.timestamp_add("DAY", F.lit(1), day)).otherwise(day).alias("last_modified"))
    return state(ledger, headers).select("url", "freshness")


@registry.query("A8_links_in_range", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE o_orderkey % 6 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def links_in_range(spark, sf_dir):
    from cosecha.sources.links import between

    rows = Views(spark, sf_dir).table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate").cast("date")).alias("date"))
    return between(rows, "date", "1996-01-01", "1998-12-31").withColumn("date", F.col("date").cast("string"))


@registry.query("A24_reviewed_names", "SELECT DISTINCT n_name AS raw, CASE n_nationkey % 3 WHEN 0 THEN 'Reviewed ' || n_name WHEN 1 THEN 'std ' || n_name ELSE n_name END AS name FROM nation")
def reviewed_names(spark, sf_dir):
    nation = Views(spark, sf_dir).table("nation")
    kind = F.col("n_nationkey") % 3
    mapping = nation.select(F.col("n_name").alias("raw"), F.when(kind == 0, F.concat(F.lit("Reviewed "), "n_name")).otherwise("").alias("canonical"), F.when(kind < 2, F.concat(F.lit("std "), "n_name")).alias("standardized"))
    return sinks.reviewed_names(nation.select(F.col("n_name").alias("raw")), mapping)


@registry.query("B3_overflow_rejects", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'overflow' ELSE 'not_a_number' END AS error_type FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0")
def overflow_rejects(spark, sf_dir):
    key = F.col("o_orderkey")
    price = F.when(key % 4 == 0, "10000000000.00").when(key % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return sinks.split_rejects(Views(spark, sf_dir).table("orders").select("o_orderkey", price.alias("price")), "price")[1].select("o_orderkey", "error_type")


@registry.query("J16_new_comments", "SELECT conv_id, turn, trim(text, ' ') AS content FROM conversations WHERE trim(text, ' ') <> ''")
def new_comments(spark, sf_dir):
    from cosecha.operators.catalog import new_comments as insertable

    rows = Views(spark, sf_dir).table("conversations").select("conv_id", "turn", F.concat(F.lit("  "), "text", F.lit(" ")).alias("content"))
    return insertable(rows)


@registry.query("N_sql_scalar_functions", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n, MAX(CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 1 THEN (l_quantity + 10) / 2 END AS DOUBLE)) AS price, MAX(CASE WHEN l_orderkey % 2 = 0 THEN 'Desconocido' ELSE l_returnflag END) AS origin FROM lineitem GROUP BY ALL")
def sql_scalar_functions(spark, sf_dir):
    register_scalars(spark)
    Views(spark, sf_dir).table("lineitem").createOrReplaceTempView("scalar_lines")
    return spark.sql("""SELECT l_orderkey, l_linenumber, count(*) AS n,
      max(effective_price(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END, 10D)) AS price,
      max(origin_label(CASE WHEN l_orderkey % 4 = 0 THEN '' WHEN l_orderkey % 2 = 1 THEN l_returnflag END)) AS origin FROM scalar_lines GROUP BY ALL""")


@registry.query("H4_union_of_layouts", """
SELECT l_orderkey % 2 = 0 AS dated, p_name AS product, COUNT(*) AS rows, MIN(l_extendedprice) AS least, MAX(l_extendedprice) AS most FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def union_of_layouts(spark, sf_dir):
    v = Views(spark, sf_dir)
    lines = v.table("lineitem").join(v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    day, name, price = F.col("l_shipdate").cast("date"), text_cell(F.col("p_name")), number_cell(F.col("l_extendedprice"))
    place = [text_cell(F.lit(x)) for x in ("73001", "Ibagué", "73", "Tolima")]
    new = F.array(date_cell(day), name, *place, price)
    old = F.array(number_cell(F.year(day)), text_cell(F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1)), name, *place, price)
    dated = F.col("l_orderkey") % 2 == 0
    sheets = lines.select(F.col("l_orderkey").alias("file"), F.lit(8).alias("row"), F.when(dated, new).otherwise(old).alias("cells"))
    rows = layouts.rice_prices(sheets)
    return rows.groupBy((F.col("file") % 2 == 0).alias("dated"), "product").agg(F.count(F.lit(1)).alias("rows"), F.min("avg_price").alias("least"), F.max("avg_price").alias("most"))

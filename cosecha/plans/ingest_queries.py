"""Queries of the incremental ingest and of the resolver that creates, over deliveries made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.functions.text import split_at_last_comma
from cosecha.operators import resolver
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views
from cosecha.session import shared_folder
from cosecha.streaming import ingest

registry = Registry()

# The newest version of each source, as if it had come alone.
_ROWS = """rows_ AS (SELECT 'file-' || o_orderkey % 40 AS source, n_nationkey AS nation, p_name, o_orderkey,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice, 2) AS DECIMAL(14,2)) + CASE WHEN o_orderkey % 40 % 5 = 0 THEN 1 ELSE 0 END END AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON o_orderkey % (SELECT COUNT(*) FROM part) = p_partkey)"""


def _delivery(spark, sf_dir: str):
    v = Views(spark, sf_dir)
    places = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    parts = v.table("part").count()
    orders = v.table("orders").join(places, "o_custkey").withColumn("p_partkey", F.col("o_orderkey") % parts).join(v.table("part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    key = F.col("o_orderkey")
    place = F.concat(F.when(key % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("  "), "n_name")), F.lit(", "))
    local = F.translate(F.format_number(F.round("o_totalprice", 2).cast("decimal(14,2)"), 2), ",.", ".,")
    rows = orders.select(
        F.concat(F.lit("file-"), (key % 40).cast("string")).alias("source"), F.lit("2020-01-01").cast("timestamp").alias("last_modified"), place.alias("place"), F.concat("p_name", F.when(key % 3 == 0, F.lit("  ")).otherwise("")).alias("product"),
        F.col("p_type").alias("category"), F.col("o_orderdate").cast("date").alias("price_date"), F.when(key % 11 != 0, local).otherwise("n.d.").alias("price"), (key % 40).alias("n"), F.col("o_totalprice").alias("raw"),
    )
    gazetteer = v.table("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_nationkey").cast("string").alias("code"))
    return rows, gazetteer


def _run(spark, sf_dir: str):
    """Two deliveries, the second with some sources restated, some new, and some changed without a later date, which do not count; then another try of what waits."""
    rows, gazetteer = _delivery(spark, sf_dir)
    folder = shared_folder(spark, "ingest")
    columns = [c.split()[0] for c in ingest.ROWS.split(", ")]
    first = rows.filter("n < 30").select(*columns)
    dearer = F.when(F.col("price") != "n.d.", F.translate(F.format_number(F.round("raw", 2).cast("decimal(14,2)") + 1, 2), ",.", ".,")).otherwise(F.col("price"))
    restated = rows.filter("n % 5 = 0").withColumns({"price": dearer, "last_modified": F.lit("2020-02-01").cast("timestamp")}).select(*columns)
    late = rows.filter("n % 5 != 0").withColumn("price", F.when(F.col("n") < 30, F.lit("1")).otherwise(F.col("price"))).select(*columns)
    small = gazetteer.filter("code != '7'")
    for delivery in (first, restated.unionByName(late)):
        delivery.write.mode("append").parquet(f"{folder}/incoming")
        ingest.ingest(spark, f"{folder}/incoming", folder, small)
    return ingest.retry_errors(spark, folder, gazetteer)


@registry.query("N_incremental_ingest", f"""
WITH {_ROWS}
SELECT source, COUNT(price) AS facts, CAST(SUM(price * 100) AS BIGINT) AS cents, COUNT(DISTINCT CASE WHEN price IS NOT NULL THEN p_name END) AS products, COUNT(DISTINCT CASE WHEN price IS NOT NULL THEN nation END) AS cities, COUNT(*) FILTER (price IS NULL) AS waiting
FROM rows_ GROUP BY source""")
def incremental_ingest(spark, sf_dir):
    store = _run(spark, sf_dir)
    facts = store.read("facts").groupBy("source").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"), F.countDistinct("product_id").alias("products"), F.countDistinct("city_id").alias("cities"))
    errors = store.read("errors").filter("not resolved").groupBy("source").agg(F.count(F.lit(1)).alias("waiting"))
    return store.read("ledger").select("source").join(facts, "source", "left").join(errors, "source", "left").fillna(0)


@registry.query("M5_created_members", f"""
WITH {_ROWS}, used AS (SELECT * FROM rows_)
SELECT 'product' AS kind, p_name AS name, sha256('product' || chr(31) || p_name) AS member_id FROM (SELECT DISTINCT p_name FROM used)
UNION ALL SELECT 'city', name, sha256('city' || chr(31) || name) FROM (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'nation_' || nation ELSE 'NATION_' || nation END AS name FROM used)
UNION ALL SELECT 'market', name, sha256('market' || chr(31) || name) FROM (SELECT DISTINCT 'Mercado municipal de ' || CASE WHEN o_orderkey % 2 = 0 THEN 'nation_' || nation ELSE 'NATION_' || nation END AS name FROM used)""")
def created_members(spark, sf_dir):
    rows, gazetteer = _delivery(spark, sf_dir)
    none = spark.createDataFrame([], "member_id string, name string"), spark.createDataFrame([], "raw_value string, member_id string")
    city = split_at_last_comma(F.col("place"))["city"]
    cities = resolver.resolve_cities(rows.select(city.alias("raw_value")), *none, gazetteer)
    named = cities.found.join(cities.members, "member_id").select(F.col("raw_value").alias("_city"), F.col("member_id").alias("city_id"), F.col("name").alias("city"))
    places = rows.select("place", city.alias("_city")).distinct().join(named, "_city")
    markets = resolver.resolve_markets(places, *none)
    products = resolver.resolve_or_create(rows.select(F.col("product").alias("raw_value")), "product", *none)
    of = lambda kind, made: made.members.select(F.lit(kind).alias("kind"), "name", "member_id")
    return of("product", products).unionByName(of("city", cities)).unionByName(of("market", markets))


@registry.query("M6_created_cities", """
WITH raws AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' || n_name || '  ' WHEN 2 THEN 'Ñ' || n_name ELSE 'no ' || n_name END AS raw_value, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 2 THEN 'Ñ' || n_name ELSE n_name END AS name,
  c_custkey % 4 AS k, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT raw_value, CASE WHEN k <> 3 THEN sha256('city' || chr(31) || name) END AS member_id, CASE WHEN k <> 3 THEN 'created' ELSE 'none' END AS resolved_by, CASE WHEN k <> 3 THEN CAST(region AS VARCHAR) END AS parent_id FROM raws""")
def created_cities(spark, sf_dir):
    v = Views(spark, sf_dir)
    kind = F.col("c_custkey") % 4
    raw = F.when(kind == 0, F.lower("n_name")).when(kind == 1, F.concat(F.lit(" "), "n_name", F.lit("  "))).when(kind == 2, F.concat(F.lit("Ñ"), "n_name")).otherwise(F.concat(F.lit("no "), "n_name"))
    raws = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(raw.alias("raw_value"))
    parent, code = F.col("n_regionkey").cast("string").alias("parent"), F.col("n_nationkey").cast("string").alias("code")
    # The gazetteer has some names without their accent.
    gazetteer = v.table("nation").select(F.col("n_name").alias("name"), parent, code).unionByName(v.table("nation").select(F.concat(F.lit("N"), "n_name").alias("name"), parent, code))
    empty = spark.createDataFrame([], "member_id string, name string"), spark.createDataFrame([], "raw_value string, member_id string")
    made = resolver.resolve_cities(raws, *empty, gazetteer)
    return made.found.join(made.members.select("member_id", "parent_id"), "member_id", "left").select("raw_value", "member_id", "resolved_by", "parent_id")

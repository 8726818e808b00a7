"""Dimension-building queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.operators import dimensions as ops
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views
from cosecha.sources import sinks

registry = Registry()

@registry.query("M16_raw_values", """
SELECT raw, kind, rows, raw AS original, CASE kind WHEN 'category' THEN upper(b[1]) || lower(b[2:]) || ' ' || n || ' *' WHEN 'city' THEN b || ' ' || n || ' *' WHEN 'product' THEN b || ' ' || n ELSE raw END AS standardized,
  replace(lower(b), '#', '') || ' ' || n AS comparison_key
FROM (SELECT p_brand || '  ' || p_name || ' *' AS raw, p_brand AS b, p_name AS n, CASE p_size % 4 WHEN 0 THEN 'category' WHEN 1 THEN 'city' WHEN 2 THEN 'product' ELSE 'other' END AS kind, COUNT(*) AS rows FROM part GROUP BY ALL)""")
def raw_values(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("category", "city", "product", "other"))), F.col("p_size") % 4)
    return ops.raw_values(Views(spark, sf_dir).table("part").select(F.concat("p_brand", F.lit("  "), "p_name", F.lit(" *")).alias("raw"), kind.alias("k")), "raw", F.col("k"))


@registry.query("M3_members_with_ids", "SELECT sha256(name) AS member_id, name FROM (SELECT DISTINCT trim(p_name) AS name FROM part) WHERE name <> ''")
def members_with_ids(spark, sf_dir):
    return ops.with_ids(Views(spark, sf_dir).table("part"), "p_name")


@registry.query("M7_backfilled", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN f ELSE p_type END AS p_type FROM part LEFT JOIN (SELECT l_partkey, MAX(l_returnflag) AS f FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def backfilled(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.table("part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("p_type"))
    found = v.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_returnflag").alias("p_type"))
    return ops.backfilled(rows, found, "p_partkey", "p_type")


@registry.query("M13_linked_codes", """
WITH codes AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_type = 'ECONOMY' AND p_brand < 'Brand#2'),
newest AS (SELECT l_suppkey % 25 AS member, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 1
  QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey % 25 ORDER BY l_shipdate DESC, p_brand) = 1),
own AS (SELECT n_nationkey AS member_id, CASE n_nationkey % 3 WHEN 0 THEN 'Brand#' || n_nationkey WHEN 1 THEN 'unknown' END AS own_code FROM nation),
linked AS (SELECT member_id, own_code, c.code AS direct, l.code AS latest FROM own LEFT JOIN codes c ON own_code = c.code LEFT JOIN newest ON member_id = member LEFT JOIN codes l ON p_brand = l.code)
SELECT member_id, COALESCE(direct, latest) AS code, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN latest IS NOT NULL THEN 'latest_price' ELSE 'none' END AS linked_by, COALESCE(own_code, direct, latest) AS own_code FROM linked""")
def linked_codes(spark, sf_dir):
    v = Views(spark, sf_dir)
    kind = F.col("n_nationkey") % 3
    own = F.when(kind == 0, F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string"))).when(kind == 1, F.lit("unknown")).otherwise("")
    members = v.table("nation").select(F.col("n_nationkey").alias("member_id"), own.alias("code"))
    lines = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    prices = lines.select((F.col("l_suppkey") % 25).alias("member_id"), F.when(F.col("l_linenumber") != 1, F.col("p_brand")).otherwise("").alias("code"), F.col("l_shipdate").alias("price_date"))
    return ops.linked_codes(members, prices, v.table("part").filter("p_type = 'ECONOMY' and p_brand < 'Brand#2'").select(F.col("p_brand").alias("code")))


@registry.query("M11_merged_by_code", """
WITH scored AS (SELECT p_partkey AS member_id, p_type AS code, p_size % 3 AS aliases, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE upper(p_name[1]) || p_name[2:] END AS name FROM part),
best AS (SELECT code, member_id AS winner FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY code ORDER BY aliases DESC, (upper(name) <> name AND lower(name) <> name) DESC, ascii(name[1]), member_id) = 1)
SELECT member_id AS loser, winner FROM scored JOIN best ON scored.code = best.code WHERE member_id <> winner""")
def merged_by_code(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.col("p_name")).otherwise(F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 100)))
    part = Views(spark, sf_dir).table("part")
    return ops.merged_by_code(part.select(F.col("p_partkey").alias("member_id"), name.alias("name"), (F.col("p_size") % 3).alias("aliases"), F.col("p_type").alias("code")))


@registry.query("M6_collision_suffix", """
WITH names AS (SELECT DISTINCT p_name, p_type FROM part), shared AS (SELECT p_name, COUNT(*) AS n FROM names GROUP BY 1)
SELECT names.p_name, p_type, CASE WHEN n > 1 THEN names.p_name || ' (' || p_type || ')' ELSE names.p_name END AS unique_name FROM names JOIN shared ON names.p_name = shared.p_name""")
def collision_suffix(spark, sf_dir):
    return ops.with_collision_suffix(Views(spark, sf_dir).table("part").select("p_name", "p_type").distinct(), "p_name", "p_type")


@registry.query("B4_insert_absent", """
SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01' UNION ALL
SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01')""")
def insert_absent(spark, sf_dir):
    orders = Views(spark, sf_dir).table("orders")
    old, new = orders.filter("o_orderdate < date '1996-01-01'"), orders.filter("o_orderdate >= date '1996-01-01'")
    return sinks.insert_absent(old.select("o_custkey"), new.select("o_custkey"), ["o_custkey"])

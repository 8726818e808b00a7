"""Conforming and data-quality queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.operators import conform, quality
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views

registry = Registry()

_RAW = """CASE p_partkey % 5 WHEN 0 THEN chr(160) || replace(p_name, ' ', '  ' || chr(160)) WHEN 1 THEN 'xx ' || p_name || ' cafÉ' WHEN 2 THEN 'xx  ' || p_name || ' cafÉ ' WHEN 3 THEN 'yy ' || p_name ELSE upper(p_name) END"""
_NAMES = """
members AS (SELECT p_name AS name, MIN(p_partkey) AS member_id FROM part GROUP BY p_name),
aliases AS (SELECT 'xx ' || name || ' cafÉ' AS raw_value, member_id FROM members WHERE length(name) > 8 UNION ALL SELECT 'xx ' || name || ' café', member_id + 1 FROM members)"""
_RESOLVED = f"""{_NAMES},
staging AS (SELECT p_partkey, {_RAW} AS raw, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'xx ' || p_name || ' café' WHEN 2 THEN 'xx ' || p_name || ' café' WHEN 3 THEN 'yy ' || p_name ELSE upper(p_name) END AS tidy FROM part),
resolved AS (SELECT p_partkey, raw, COALESCE(a.member_id, k.member_id, m.member_id) AS member_id,
  CASE WHEN a.member_id IS NOT NULL THEN 'alias' WHEN k.member_id IS NOT NULL THEN 'alias_key' WHEN m.member_id IS NOT NULL THEN 'name' ELSE 'none' END AS resolved_by
  FROM staging s LEFT JOIN aliases a ON s.raw = a.raw_value LEFT JOIN aliases k ON s.tidy = k.raw_value LEFT JOIN members m ON s.tidy = m.name)"""


def _names(spark, sf_dir):
    """Raw names with blanks of two kinds, inner capitals and other letters, aliases of some, and the members."""
    part = Views(spark, sf_dir).table("part")
    members = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("member_id"))
    alias = lambda end: F.concat(F.lit("xx "), "name", F.lit(end))
    aliases = members.filter(F.length("name") > 8).select(alias(" cafÉ").alias("raw_value"), "member_id").unionByName(members.select(alias(" café").alias("raw_value"), (F.col("member_id") + 1).alias("member_id")))
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("\u00a0"), F.replace("p_name", F.lit(" "), F.lit("  \u00a0")))).when(kind == 1, F.concat(F.lit("xx "), "p_name", F.lit(" cafÉ")))
    raw = raw.when(kind == 2, F.concat(F.lit("xx  "), "p_name", F.lit(" cafÉ "))).when(kind == 3, F.concat(F.lit("yy "), "p_name")).otherwise(F.upper("p_name"))
    return part.select("p_partkey", raw.alias("raw")), aliases, members


@registry.query("D1_conforming_join", f"WITH {_RESOLVED} SELECT p_partkey, CAST(member_id AS VARCHAR) AS member_id, resolved_by FROM resolved")
def conforming_join(spark, sf_dir):
    staging, aliases, members = _names(spark, sf_dir)
    return conform.resolve(staging, "raw", aliases, members).select("p_partkey", F.col("member_id").cast("string").alias("member_id"), "resolved_by")


@registry.query("J37_alias_gaps", f"WITH {_RESOLVED} SELECT raw, COUNT(*) AS rows FROM resolved WHERE member_id IS NULL GROUP BY raw")
def alias_gaps(spark, sf_dir):
    staging, aliases, members = _names(spark, sf_dir)
    return conform.gaps(conform.resolve(staging, "raw", aliases, members), "raw")


# Doubled letters, Cyrillic, signs and accents; the key is worked out by hand.
_NAMED = """CASE p_partkey % 5 WHEN 0 THEN regexp_replace(p_name, '(.)', '\\1\\1', 'g') WHEN 1 THEN 'Груша*' || p_brand WHEN 2 THEN 'Яблоко, ' || p_brand WHEN 3 THEN '** !' ELSE 'Ñ' || upper(p_name) END"""
_KEYED = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'груша ' || replace(lower(p_brand), '#', ' ') WHEN 2 THEN 'яблоко ' || replace(lower(p_brand), '#', ' ') WHEN 3 THEN '' ELSE 'n' || p_name END"""
_MEMBERS = f"parts AS (SELECT p_partkey AS member_id, {_NAMED} AS name, {_KEYED} AS k, p_partkey % 3 <> 0 AS old FROM part)"
_MERGES = f"""{_MEMBERS},
used AS (SELECT member_id, k, old, COUNT(l_partkey) AS uses FROM parts LEFT JOIN lineitem ON member_id = l_partkey WHERE k <> '' GROUP BY ALL),
best AS (SELECT k, member_id AS winner FROM used WHERE old QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY uses DESC, member_id) = 1),
merges AS (SELECT member_id AS loser, winner FROM used JOIN best ON used.k = best.k WHERE NOT old)"""


def _members(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    name = F.when(kind == 0, F.regexp_replace("p_name", "(.)", "$1$1")).when(kind == 1, F.concat(F.lit("Груша*"), "p_brand")).when(kind == 2, F.concat(F.lit("Яблоко, "), "p_brand"))
    name = name.when(kind == 3, F.lit("** !")).otherwise(F.concat(F.lit("Ñ"), F.upper("p_name")))
    return Views(spark, sf_dir).table("part").select(F.col("p_partkey").alias("member_id"), name.alias("name"))


def _merges(spark, sf_dir):
    members = _members(spark, sf_dir)
    references = Views(spark, sf_dir).table("lineitem").select(F.col("l_partkey").alias("member_id"))
    return conform.survivors(members, references, members.filter("member_id % 3 != 0"))


@registry.query("J38_duplicate_groups", f"WITH {_MEMBERS} SELECT k AS norm_key, COUNT(*) AS members, MIN(member_id) AS smallest FROM parts WHERE k <> '' GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_groups(spark, sf_dir):
    return conform.duplicate_groups(_members(spark, sf_dir))


@registry.query("M10_survivors", f"WITH {_MERGES} SELECT * FROM merges")
def survivors(spark, sf_dir):
    return _merges(spark, sf_dir)


@registry.query("D22_rewritten_keys", f"WITH {_MERGES} SELECT COALESCE(winner, l_partkey) AS l_partkey, COUNT(*) AS rows FROM lineitem LEFT JOIN merges ON l_partkey = loser GROUP BY 1")
def rewritten_keys(spark, sf_dir):
    facts = Views(spark, sf_dir).table("lineitem").select("l_partkey")
    return conform.rewrite_keys(facts, "l_partkey", conform.closed_merges(_merges(spark, sf_dir))).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("rows"))


@registry.query("E14_most_frequent_parent", """
SELECT p_name, p_type, rows FROM (SELECT p_name, p_type, COUNT(*) AS rows FROM part WHERE p_type IS NOT NULL GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY rows DESC, p_type) = 1""")
def most_frequent_parent(spark, sf_dir):
    return conform.most_frequent_parent(Views(spark, sf_dir).table("part"), "p_name", "p_type")


@registry.query("D15_fuzzy_best_match")
def fuzzy_best_match(spark, sf_dir):
    staging, _, members = _names(spark, sf_dir)
    return conform.fuzzy_best(staging.select(F.col("raw").alias("value")), members)


# The longest common piece of two stretches, the first of equal ones; then those to its left and right.
_PIECE = """list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
  {'k': coalesce(list_max(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: a[i + 1:i + n] = b[j + 1:j + n])), 0), 'i': -i, 'j': -j}))))"""


@registry.query("D15_fuzzy_all_matches", f"""
WITH RECURSIVE staging AS (SELECT DISTINCT {_RAW} AS value, CASE p_partkey % 5 WHEN 1 THEN 'xx ' || p_name || ' cafe' WHEN 2 THEN 'xx ' || p_name || ' cafe' WHEN 3 THEN 'yy ' || p_name ELSE p_name END AS a FROM part),
names AS (SELECT DISTINCT p_name AS b FROM part),
pairs AS (SELECT a, b FROM (SELECT DISTINCT a FROM staging), names WHERE 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 0.6),
pieces AS (
  SELECT a, b, alo, ahi, blo, bhi, {_PIECE} AS m FROM (SELECT a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi FROM pairs)
  UNION ALL
  SELECT a, b, alo, ahi, blo, bhi, {_PIECE} AS m FROM (
    SELECT a, b, c.alo, c.ahi, c.blo, c.bhi FROM (
      SELECT a, b, UNNEST([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS c FROM pieces WHERE m.k > 0)
    WHERE c.alo < c.ahi AND c.blo < c.bhi)),
ratios AS (SELECT a, b, 2.0 * SUM(m.k) / (length(a) + length(b)) AS ratio FROM pieces GROUP BY a, b)
SELECT value, b AS name, round(ratio, 6) AS ratio, ratio >= 0.7 AS over_70, ratio >= 0.85 AS over_85 FROM staging JOIN ratios USING (a) WHERE ratio >= 0.6""")
def fuzzy_all_matches(spark, sf_dir):
    staging, _, members = _names(spark, sf_dir)
    found = conform.fuzzy_matches(staging.select(F.col("raw").alias("value")), members, 0.6)
    return found.select("value", "name", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= 0.7).alias("over_70"), (F.col("ratio") >= 0.85).alias("over_85"))


@registry.query("F11_forward_fill", """
SELECT event_id, user_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def forward_fill(spark, sf_dir):
    events = Views(spark, sf_dir).table("events").withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    return events.select("event_id", "user_id", conform.forward_filled(events, "paid", "event_id", ["user_id"]).alias("last_purchase"))


@registry.query("J35_coverage_by_month", """
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
expected AS (SELECT CAST(day AS DATE) AS day FROM (SELECT UNNEST(generate_series((SELECT MIN(day) FROM days), (SELECT MAX(day) FROM days), INTERVAL 1 DAY)) AS day) WHERE isodow(day) < 7)
SELECT strftime(COALESCE(e.day, d.day), '%Y-%m') AS month, COUNT(e.day) AS expected, COUNT(*) FILTER (e.day IS NOT NULL AND d.day IS NOT NULL) AS present,
  COUNT(*) FILTER (e.day IS NOT NULL AND d.day IS NULL) AS missing, COUNT(*) FILTER (e.day IS NULL AND d.day IS NOT NULL) AS unexpected
FROM expected e FULL JOIN days d ON e.day = d.day GROUP BY 1""")
def coverage_by_month(spark, sf_dir):
    return quality.coverage(Views(spark, sf_dir).table("orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


@registry.query("H1_date_differences", """
WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT CAST(day AS VARCHAR) AS day, 'missing' AS side FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT CAST(day AS VARCHAR), 'unexpected' FROM b WHERE day NOT IN (SELECT day FROM a)""")
def date_differences(spark, sf_dir):
    v = Views(spark, sf_dir)
    day = lambda t, c: v.table(t).select(F.col(c).cast("date").cast("string").alias("day"))
    return quality.differences(day("orders", "o_orderdate"), day("lineitem", "l_shipdate"), "day")


def _errors(spark, sf_dir):
    events = Views(spark, sf_dir).table("events")
    errors = events.select(F.col("event_id").alias("error_id"), F.col("event_type").alias("error_type"), F.col("ts").alias("created_at"), (F.col("value") > 20).alias("resolved"), F.col("user_id").alias("source"))
    return errors, events.filter("event_type = 'purchase' and value > 60").select(F.col("user_id").alias("source"))


@registry.query("J36_error_report", """
WITH open_ AS (SELECT * FROM events WHERE NOT value > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)),
placed AS (SELECT event_type AS error_type, COUNT(*) OVER (PARTITION BY event_type) AS errors, CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, event_id AS error_id, user_id AS source FROM open_)
SELECT * FROM placed WHERE place <= 50""")
def error_report(spark, sf_dir):
    return quality.error_report(*_errors(spark, sf_dir))


@registry.query("E28_latencies", """
SELECT event_type, COUNT(value) AS n, MIN(value) AS low, MAX(value) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def latencies(spark, sf_dir):
    return quality.latencies(Views(spark, sf_dir).table("events"), "event_type", "value")


@registry.query("E29_reference_counts", """
SELECT p_partkey, COALESCE(a.n, 0) AS lines, COALESCE(b.n, 0) AS returns, COALESCE(a.n, 0) + COALESCE(b.n, 0) AS uses FROM part
LEFT JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1) a ON p_partkey = a.l_partkey
LEFT JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON p_partkey = b.l_partkey""")
def reference_counts(spark, sf_dir):
    v = Views(spark, sf_dir)
    lines = v.table("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return quality.reference_counts(v.table("part"), {"lines": lines, "returns": lines.filter("l_returnflag = 'R'")}, "p_partkey")


@registry.query("F1_without_duplicates", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice) = 1""")
def without_duplicates(spark, sf_dir):
    lines = Views(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return quality.without_duplicates(lines, ["l_orderkey", "l_linenumber"], F.asc("l_shipdate"), F.asc("l_extendedprice")).drop("l_shipdate")

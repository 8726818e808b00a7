"""Queries of the merge engine over parts as members, beside SQL that plans and applies the merges by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.operators import merges
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views

registry = Registry()

_QUALITY = """(CASE WHEN up > 0.6 * al AND al > 5 THEN -50 WHEN up > 0.4 * al AND al > 10 THEN -30 ELSE 0 END + CASE WHEN name = lower(name) AND length(name) > 3 THEN -30 ELSE 0 END
  + CASE WHEN regexp_matches(name, '[a-z][A-Z]') THEN -20 ELSE 0 END + CASE WHEN regexp_matches(name, '^[A-Z]') AND name <> upper(name) THEN 15 ELSE 0 END + CASE WHEN contains(name, '*') THEN -15 ELSE 0 END
  + CASE WHEN regexp_matches(name, '[A-Z]{5,}') AND name <> upper(name) THEN -25 ELSE 0 END + CASE WHEN length(name) BETWEEN 6 AND 49 THEN 5 ELSE 0 END)"""
_BASE = "p_name || ' ' || lower(p_brand)"
# Members in several spellings, some sent to a group or out by an override, some tied to the next one but five by hand.
_PLAN = f"""RECURSIVE members AS (
  SELECT p_partkey AS member_id, {_BASE} AS g, p_brand, CASE p_partkey % 6 WHEN 0 THEN upper(p_name[1]) || p_name[2:] || ' ' || lower(p_brand) WHEN 1 THEN upper({_BASE}) || ' *' WHEN 2 THEN replace(p_name, ' ', '  ') || ', ' || lower(p_brand) || '.'
    WHEN 3 THEN upper(p_name) || ' ' || lower(p_brand) WHEN 4 THEN 'otro ' || {_BASE} ELSE '-/ borrar ' || lower(p_brand) END AS name FROM part),
left_ AS (SELECT * FROM members WHERE member_id % 6 <> 5),
links AS (SELECT a.g AS a, b.g AS b FROM left_ a JOIN left_ b ON a.member_id % 60 = 0 AND b.member_id = a.member_id + 6),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT g AS a, g AS b FROM left_ UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON r.b = l.a),
component AS (SELECT a AS g, MIN(b) AS component FROM reach GROUP BY a),
scored AS (SELECT left_.*, component, CASE WHEN p_brand = 'Brand#1' THEN upper(p_name_) || ' ' || lower(p_brand) END AS own, length(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS al, length(regexp_replace(name, '[^A-Z]', '', 'g')) AS up
  FROM (SELECT *, g[:length(g) - length(p_brand) - 1] AS p_name_ FROM left_) left_ JOIN component USING (g)),
heads AS (SELECT component, COUNT(*) AS size, MIN(own) AS own, MIN({{'s': -{_QUALITY}, 'n': name}}) AS best FROM scored GROUP BY component),
proper AS (SELECT component, COALESCE(own, best.n) AS proper FROM heads WHERE size > 1),
winners AS (SELECT component, proper, member_id AS winner FROM scored JOIN proper USING (component) QUALIFY ROW_NUMBER() OVER (PARTITION BY component ORDER BY name = proper DESC, member_id) = 1),
plan AS (SELECT member_id, CASE WHEN member_id <> winner THEN 'merge' WHEN name <> proper THEN 'rename' ELSE 'keep' END AS action, winner, proper AS name FROM scored JOIN winners USING (component)
  UNION ALL SELECT member_id, 'delete', NULL, NULL FROM members WHERE member_id % 6 = 5)"""


def _members(spark, sf_dir: str):
    """(members, overrides, pairs)"""
    part = Views(spark, sf_dir).table("part")
    kind, low = F.col("p_partkey") % 6, F.lower("p_brand")
    base = F.concat_ws(" ", "p_name", low)
    name = F.when(kind == 0, F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring(base, 2, 200))).when(kind == 1, F.concat(F.upper(base), F.lit(" *")))
    name = name.when(kind == 2, F.concat(F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(", "), low, F.lit("."))).when(kind == 3, F.concat_ws(" ", F.upper("p_name"), low))
    name = name.when(kind == 4, F.concat(F.lit("otro "), base)).otherwise(F.concat(F.lit("-/ borrar "), low))
    members = part.select(F.col("p_partkey").alias("member_id"), name.alias("name"))
    sent = part.filter("p_partkey % 6 = 4").select(F.concat(F.lit("otro "), base).alias("key"), F.initcap(base).alias("target"))
    own = part.filter("p_brand = 'Brand#1'").select(base.alias("key"), F.concat_ws(" ", F.upper("p_name"), low).alias("target"))
    none = part.filter("p_partkey % 6 = 5").select(F.concat(F.lit("borrar "), low).alias("key"), F.lit(None).cast("string").alias("target"))
    overrides = sent.unionByName(own).unionByName(none).distinct()
    pairs = members.filter("member_id % 60 = 0").select(F.col("member_id").alias("loser"), (F.col("member_id") + 6).alias("winner"))
    return members, overrides, pairs


@registry.query("M8_merge_plan", f"WITH {_PLAN} SELECT member_id, action, CAST(winner AS VARCHAR) AS winner, name FROM plan")
def merge_plan(spark, sf_dir):
    return merges.merge_plan(*_members(spark, sf_dir)).withColumn("winner", F.col("winner").cast("string"))


@registry.query("M8_merged_members", f"""WITH {_PLAN} SELECT member_id, COALESCE(plan.name, members.name) AS name FROM members LEFT JOIN plan USING (member_id) WHERE action IS NULL OR action IN ('keep', 'rename')""")
def merged_members(spark, sf_dir):
    members, overrides, pairs = _members(spark, sf_dir)
    return merges.merged_members(members, merges.merge_plan(members, overrides, pairs))


@registry.query("M8_merged_aliases", f"""WITH {_PLAN},
aliases AS (SELECT 'alias ' || member_id // 2 AS raw_value, member_id FROM members WHERE member_id % 2 = 0 UNION ALL SELECT name, MIN(member_id) FROM members WHERE member_id % 3 = 0 GROUP BY name),
moved AS (SELECT raw_value, COALESCE(winner, a.member_id) AS member_id, 0 AS rank FROM aliases a LEFT JOIN plan USING (member_id) WHERE action IS NULL OR action <> 'delete'
  UNION ALL SELECT members.name, winner, 1 FROM members JOIN plan USING (member_id) WHERE action IN ('merge', 'rename'))
SELECT raw_value, member_id FROM moved QUALIFY ROW_NUMBER() OVER (PARTITION BY raw_value ORDER BY rank, member_id) = 1""")
def merged_aliases(spark, sf_dir):
    members, overrides, pairs = _members(spark, sf_dir)
    aliases = members.filter("member_id % 2 = 0").select(F.concat(F.lit("alias "), F.floor(F.col("member_id") / 2).cast("string")).alias("raw_value"), "member_id")
    aliases = aliases.unionByName(members.filter("member_id % 3 = 0").groupBy(F.col("name").alias("raw_value")).agg(F.min("member_id").alias("member_id")))
    return merges.merged_aliases(aliases, members, merges.merge_plan(members, overrides, pairs))


@registry.query("M8_rewritten_facts", f"""WITH {_PLAN},
lines AS (SELECT DISTINCT l_partkey, l_suppkey % 40 AS other, l_linenumber FROM lineitem),
fresh AS (SELECT l_partkey AS old, other AS old_other, CASE WHEN p.action IN ('merge', 'delete') THEN p.winner ELSE l_partkey END AS part, CASE WHEN o.action IN ('merge', 'delete') THEN o.winner ELSE other END AS other, l_linenumber,
  COALESCE(p.action, '') IN ('merge', 'delete') OR COALESCE(o.action, '') IN ('merge', 'delete') AS moved
  FROM lines LEFT JOIN plan p ON l_partkey = p.member_id LEFT JOIN plan o ON other = o.member_id),
touched AS (SELECT *, COALESCE(part IN (SELECT winner FROM plan WHERE action = 'merge') OR other IN (SELECT winner FROM plan WHERE action = 'merge'), FALSE) AS touched FROM fresh)
SELECT CAST(part AS VARCHAR) AS part, CAST(other AS VARCHAR) AS other, COUNT(*) AS rows, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM (
  SELECT * FROM touched WHERE NOT touched
  UNION ALL SELECT * FROM touched WHERE touched QUALIFY NOT bool_or(moved) OVER (PARTITION BY part, other) OR ROW_NUMBER() OVER (PARTITION BY part, other ORDER BY moved, l_linenumber DESC, old, old_other) = 1) GROUP BY 1, 2""")
def rewritten_facts(spark, sf_dir):
    plan = merges.merge_plan(*_members(spark, sf_dir))
    lines = Views(spark, sf_dir).table("lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 40).alias("other"), "l_linenumber").distinct()
    lines = lines.withColumns({"old": F.col("part"), "old_other": F.col("other")})
    out = merges.rewritten(lines, {"part": plan, "other": plan}, ["part", "other"], [F.desc("l_linenumber"), F.asc("old"), F.asc("old_other")])
    totals = out.groupBy("part", "other").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").alias("lines"))
    return totals.withColumns({c: F.col(c).cast("string") for c in ("part", "other")})

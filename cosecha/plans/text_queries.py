"""Text-function queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.functions import names
from cosecha.functions import text as fn
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views

registry = Registry()

_SPACES = f"{fn.BLANK}+"
#: The letters' table as a SQL expression around another.
_PLAIN = "translate({0}, '" + fn.ACCENTED.replace("'", "''") + "', '" + fn.PLAIN.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"
_KEY = f"trim(regexp_replace(regexp_replace({_PLAIN.format('lower(text)')}, '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@registry.query("L1_parse_price", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN CAST(replace(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '.', '') AS DOUBLE)
  WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) WHEN 5 THEN CAST(o_orderkey AS DOUBLE) WHEN 6 THEN CAST(o_custkey + 1 AS DOUBLE) END AS price FROM orders""")
def parse_price(spark, sf_dir):
    number = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 8
    odd = F.get(F.array(*map(F.lit, ("nan", "Infinity", "-inf"))), (F.col("o_orderkey") % 3).cast("int"))
    raw = F.when(kind == 0, "n.d.").when(kind == 1, number).when(kind == 2, F.translate(number, ".", ",")).when(kind == 3, F.concat(key, F.lit("d"))).when(kind == 4, odd)
    raw = raw.when(kind == 5, F.concat(F.lit("\u00a0"), key, F.lit("\u2009"))).when(kind == 6, F.concat(F.lit("+"), (F.col("o_custkey") + 1).cast("string"), F.lit("e0"))).otherwise(F.concat(F.lit("-"), number))
    return Views(spark, sf_dir).table("orders").select("o_orderkey", fn.parse_price(raw).alias("price"))


@registry.query("L2_parse_spanish_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def parse_spanish_date(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    month = F.get(F.array(*map(F.lit, fn.MONTHS)), F.month(date) - 1)
    raw = F.concat(F.lit("Bogotá, lunes "), F.dayofmonth(date).cast("string"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year(date).cast("string"))
    return Views(spark, sf_dir).table("orders").select("o_orderkey", fn.parse_spanish_date(raw).cast("string").alias("date"))


@registry.query("L5_collapse_spaces", f"SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))) AS digest FROM documents")
def collapse_spaces(spark, sf_dir):
    # Blanks that do not break, and others beyond ASCII, count like any other.
    wide = F.concat(F.lit("\u2003"), F.replace("text", F.lit(" "), F.lit("\u00a0 ")), F.lit("\u3000\n"))
    return Views(spark, sf_dir).table("documents").select("doc_id", F.md5(fn.collapse_spaces(wide)).alias("digest"))


@registry.query("L7_strip_accents", f"SELECT doc_id, md5({_PLAIN.format('text')}) AS digest FROM documents")
def strip_accents(spark, sf_dir):
    return Views(spark, sf_dir).table("documents").select("doc_id", F.md5(fn.strip_accents(F.col("text"))).alias("digest"))


@registry.query("L9_comparison_key", f"SELECT doc_id, md5({_KEY}) AS digest FROM documents")
def comparison_key(spark, sf_dir):
    return Views(spark, sf_dir).table("documents").select("doc_id", F.md5(fn.comparison_key(F.col("text"))).alias("digest"))


@registry.query("L12_undouble", "SELECT p_partkey, p_name AS name FROM part")
def undouble(spark, sf_dir):
    doubled = F.regexp_replace("p_name", "(.)", "$1$1")
    return Views(spark, sf_dir).table("part").select("p_partkey", fn.undouble(doubled).alias("name"))


@registry.query("L17_slug", """SELECT p_partkey, 'nandu_' || replace(p_name, ' ', '_') || '_' || replace(lower(p_brand), '#', '') || '-x' AS slug FROM part""")
def slug(spark, sf_dir):
    name = F.concat(F.lit("-_ Ñandú, "), F.upper("p_name"), F.lit(" ("), "p_brand", F.lit(")--x ²ж*_"))
    return Views(spark, sf_dir).table("part").select("p_partkey", fn.slug(name).alias("slug"))


@registry.query("L13_norm_key", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'яблоко ' || p_name || ' nandu ff' WHEN 2 THEN '' ELSE p_name || ' x_1' END AS norm_key FROM part""")
def norm_key(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.regexp_replace("p_name", "(.)", "$1$1")).when(kind == 1, F.concat(F.lit("\u00a0Яблоко (¡"), "p_name", F.lit("!) Ñandú ﬀ"))).when(kind == 2, F.lit(" *¡!+ ")).otherwise(F.concat(F.upper("p_name"), F.lit("-\tX_1")))
    return Views(spark, sf_dir).table("part").select("p_partkey", fn.norm_key(name).alias("norm_key"))


@registry.query("L18_base_product", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN 'huevo' WHEN 2 THEN replace(p_name, ' ', '_') || '_secoya' WHEN 3 THEN 'papa_' || replace(p_name, ' ', '_') WHEN 4 THEN 'name_' || replace(p_name, ' ', '_') || '_entero' ELSE 'queso_' || replace(p_name, ' ', '_') END AS key,
  CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'huevo' WHEN 2 THEN p_name || '  ya' WHEN 3 THEN 'papa ' || p_name WHEN 4 THEN 'ñame ' || p_name || ' entero' ELSE 'queso ' || p_name || ' nacional' END AS search FROM part""")
def base_product(spark, sf_dir):
    kind, name = F.col("p_partkey") % 6, F.upper("p_name")
    text = F.when(kind == 0, F.concat(name, F.lit(", costilla *"))).when(kind == 1, F.concat(name, F.lit(" Huevo rojo"))).when(kind == 2, F.concat(name, F.lit(" entero secoya, filete")))
    text = text.when(kind == 3, F.concat(F.lit("Papa  "), name, F.lit(" Pastusa*+"))).when(kind == 4, F.concat(F.lit("Ñame "), name, F.lit(" entero"))).otherwise(F.concat(F.lit("Queso "), name, F.lit(" nacional")))
    category = F.when(kind == 0, "Carnes").when(kind == 2, "Pescados").when(kind == 3, "Tubérculos")
    return Views(spark, sf_dir).table("part").select("p_partkey", names.base_product(text, category).alias("key"), names.searched_product(text, category).alias("search"))


@registry.query("L20_compact_number", """
SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1f', floor(v / 1000000 * 10 + 0.5) / 10) || ' M' WHEN v >= 1000 THEN printf('%.1f', floor(v / 1000 * 10 + 0.5) / 10) || ' K'
  ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END AS label FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 50) AS v FROM orders)""")
def compact_number(spark, sf_dir):
    return Views(spark, sf_dir).table("orders").select("o_orderkey", fn.compact_number(F.col("o_totalprice") * (F.col("o_orderkey") % 50)).alias("label"))


@registry.query("L22_zero_padded", "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer")
def zero_padded(spark, sf_dir):
    return Views(spark, sf_dir).table("customer").select("c_custkey", fn.zero_padded(F.col("c_custkey").cast("string"), 3).alias("code"))


@registry.query("L20_spanish_date", f"""
SELECT o_orderkey, day(o_orderdate) || ' ' || list_extract({fn.MONTH_FORMS}, month(o_orderdate)) || ' ' || year(o_orderdate) AS label FROM orders""")
def spanish_date(spark, sf_dir):
    return Views(spark, sf_dir).table("orders").select("o_orderkey", fn.spanish_date(F.col("o_orderdate").cast("date")).alias("label"))


@registry.query("L29_storage_path", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') || '/pdf/boletin ' || o_orderkey || '.pdf' AS path FROM orders")
def storage_path(spark, sf_dir):
    name = F.concat(F.lit("boletín *"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return Views(spark, sf_dir).table("orders").select("o_orderkey", fn.storage_path(F.col("o_orderdate").cast("date"), F.lit("pdf"), name).alias("path"))

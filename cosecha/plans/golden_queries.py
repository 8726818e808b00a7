"""Queries over layouts of bulletins, pages and recognised documents, dealt to all rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cosecha.functions import names
from cosecha.functions import text as fn
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views
from cosecha.sources import bulletins, layouts, links

registry = Registry()


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def _grid(spark, sf_dir: str, rows: Sequence[tuple], fields: str):
    """``rows`` (row, cells, ..) for every customer as a file."""
    table = spark.createDataFrame(list(rows), fields)
    each = F.explode(F.array(*[F.struct(*[_literal(v).alias(f.name) for f, v in zip(table.schema.fields, r, strict=True)]) for r in rows]))
    return Views(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("file"), each.alias("r")).select("file", "r.*")


def _literal(value: object) -> Column:
    return F.array(*[F.lit(c).cast("string") for c in value]) if isinstance(value, list) else F.lit(value)


def _every_file(columns: str, rows: Sequence[Sequence[object]]) -> str:
    values = ", ".join(f"({', '.join(_sql(v) for v in row)})" for row in rows)
    return f"SELECT c_custkey AS file, v.* FROM customer CROSS JOIN (VALUES {values}) v({columns})"


def _bulletin(spark, sf_dir: str):
    """(file, row, cells): a bulletin for each order, with a heading for each of its lines' brands as they change."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    v = Views(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    lines = v.table("lineitem").select("l_orderkey", *order).join(v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn("nth", nth)
    row = lambda at, *cells: F.struct(F.lit(at).cast("int").alias("row") if isinstance(at, int) else at.cast("int").alias("row"), F.array(*cells).alias("cells"))
    text, local = F.lit, lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    heads = [row(0, text("PRECIOS DE VENTA"), text(""), text("")), row(1, text("Sin grupo"), text("kg"), text("1"), text("100"), text("120")), row(2, text("Frutas")), row(3, text("Cítricos"))]
    heads += [row(1000, text("Nota")), row(1001, text("CARNES")), row(1002, text("Res"), text("kg"), text("1"), text("15.000"), text("16.000"))]
    bare = v.table("orders").select(F.col("o_orderkey").alias("file"), F.explode(F.array(*heads)).alias("r"))
    low, high = local(F.col("l_extendedprice")), local(F.col("l_extendedprice") + 10)
    second = [F.when(F.col("nth") % 2 == 0, local(F.col("l_quantity"))).otherwise("0"), F.when(F.col("nth") % 2 == 0, local(F.col("l_quantity") + 1)).otherwise("n.d.")]
    above = F.when(F.col("nth") > 1, row(2 * F.col("nth") + 3, F.when(F.col("nth") % 3 == 0, "Otras frutas").otherwise("Cítricos")))
    body = F.array(above, row(2 * F.col("nth") + 4, F.col("p_name"), text("caja"), F.col("nth").cast("string"), low, high, *second))
    return bare.unionByName(lines.select(F.col("l_orderkey").alias("file"), F.explode(body).alias("r")).filter("r is not null")).select("file", "r.*")


_BULLETIN_LINES = """lines AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS nth FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@registry.query("A10_bulletin_prices", f"""WITH {_BULLETIN_LINES}
SELECT l_orderkey AS file, 2 * nth + 4 AS "row", 'Frutas' AS category, CASE WHEN nth % 3 = 0 THEN 'Otras frutas' ELSE 'Cítricos' END AS subcategory, p_name AS product, 'caja' AS presentation, CAST(nth AS VARCHAR) AS units, r.k AS round, r.low AS min_price, r.high AS max_price
FROM lines, LATERAL (VALUES (1, l_extendedprice, l_extendedprice + 10), (2, CASE WHEN nth % 2 = 0 THEN l_quantity END, CASE WHEN nth % 2 = 0 THEN l_quantity + 1 END)) r(k, low, high) WHERE r.low IS NOT NULL
UNION ALL SELECT o_orderkey, 1002, 'CARNES', '', 'Res', 'kg', '1', 1, 15000, 16000 FROM orders""")
def bulletin_prices(spark, sf_dir):
    found = bulletins.bulletin_prices(_bulletin(spark, sf_dir))[0]
    return found.withColumns({c: F.round(c, 2) for c in ("min_price", "max_price")})


@registry.query("B8_rows_without_category", """SELECT o_orderkey AS file, 1 AS "row", 'missing_category' AS error_type, 'no category: Sin grupo' AS error_message FROM orders""")
def rows_without_category(spark, sf_dir):
    return bulletins.bulletin_prices(_bulletin(spark, sf_dir))[1]


@registry.query("A12_arrival_tables", "SELECT c_custkey AS file, c_custkey % 3 <> 0 AS arrivals FROM customer")
def arrival_tables(spark, sf_dir):
    first = F.when(F.col("file") % 3 == 0, F.array(F.lit("Papa"), F.lit("1.200"))).when(F.col("file") % 3 == 1, F.array(F.lit("Producto"), F.lit("Lunes"), F.lit("Martes"))).otherwise(F.array(F.lit("x"), F.lit("01/02/2020"), F.lit("02/02/2020")))
    late = F.array(F.lit("Mercado mayorista"))
    rows = Views(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("file"))
    grid = rows.withColumn("r", F.explode(F.array(F.struct(F.lit(0).alias("row"), first.alias("cells")), F.struct(F.lit(5).alias("row"), late.alias("cells"))))).select("file", "r.*")
    return bulletins.is_arrival_table(grid)


@registry.query("A13_recognised_prices", """
SELECT o_orderkey AS file, 'p' || o_custkey AS product, CASE WHEN o_orderkey % 2 = 0 THEN 'kg' END AS presentation, CASE WHEN o_orderkey % 2 = 0 THEN '1' END AS units, round(o_totalprice, 2) AS min_price, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) + 1 END AS max_price FROM orders WHERE o_orderkey % 7 <> 0""")
def recognised_prices(spark, sf_dir):
    local = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    low, product = local(F.round("o_totalprice", 2)), F.concat(F.lit(" p"), F.col("o_custkey").cast("string"))
    spanish = F.to_json(F.array(F.struct(product.alias("producto"), F.lit("kg").alias("presentacion"), F.lit("1").alias("unidades"), low.alias("precio_minimo"), local(F.round("o_totalprice", 2) + 1).alias("precio_maximo"))))
    english = F.to_json(F.array(F.struct(product.alias("product"), low.alias("min_price")), F.struct(F.lit("Ajo").alias("product"), F.lit("n.d.").alias("min_price"))))
    payload = F.when(F.col("o_orderkey") % 7 == 0, F.lit("no list")).when(F.col("o_orderkey") % 2 == 0, spanish).otherwise(english)
    rows = layouts.recognised_prices(Views(spark, sf_dir).table("orders").select(F.col("o_orderkey").alias("file"), payload.alias("payload")))
    return rows.withColumns({c: F.round(c, 2) for c in ("min_price", "max_price")})


# Pages of each layout, with addresses and texts of a part; quotes of both kinds, entities, a comment and a nested table.
_FOUR = """concat('<table class=x><tr><th>Día<th>Boletín<th>Anexos<th>Ciudades</tr><tr><td>5 de enero</td><td><a href="/files/b', k, '.pdf">Boletín</a></td><td><A class="x" HREF=\\'/files/anex-', k, '&amp;x.xlsx\\'><b>Anexo</b> ', p_name, '</A></td>',
  '<td><table><tr><td>x</table><a href=/files/c', k, '.zip>Informes por ciudades</a></td></tr></table><!-- <a href="/files/no.pdf">no</a> --><a href="/files/out.pdf">fuera</a>')"""
_THREE = """concat('<table><tr><td>7 de marzo de 2017<td><a href="/files/bol_', k, '.pdf">Doc</a><td><a href="/files/mayoristas_marzo_8_2017.xlsx">', p_name, '</a></tr></table>')"""
_BULLETS = """concat('<ul><li><a href="/files/bol_ago_31_2012.pdf">Boletín - 31 de agosto</a></li><li><a href="/files/mayoristas_', k, '">Anexo - 31 de agosto</a></li></ul>')"""
_SIMPLE = """concat('<a href="/files/mayoristas_julio_31_2012.xls">31 de julio de 2012</a> <a href="/files/otro', k, '.xls">', p_name, '</a>')"""
_PAGES = [("/p-2021", _FOUR, "CAST(NULL AS DATE)"), ("/p", _FOUR, "DATE '2021-01-31'"), ("/p", _THREE, "DATE '2017-03-31'"), ("/agosto-de-2012-1", _BULLETS, "DATE '2012-08-31'"), ("/p", _SIMPLE, "DATE '2012-07-31'"), ("/p", _SIMPLE, "CAST(NULL AS DATE)")]


@registry.query("A1_page_files", """
SELECT p_partkey AS page_id, v.href, v.text, v.kind, v.category, v.date FROM part, LATERAL (VALUES
  (0, '/files/anex-' || p_partkey || '&x.xlsx', 'Anexo' || p_name, 'excel', 'anexo', '2021-01-05'), (0, '/files/c' || p_partkey || '.zip', 'Informes por ciudades', 'zip', 'informes_ciudades', '2021-01-05'),
  (1, '/files/anex-' || p_partkey || '&x.xlsx', 'Anexo' || p_name, 'excel', 'anexo', '2021-01-05'), (1, '/files/c' || p_partkey || '.zip', 'Informes por ciudades', 'zip', 'informes_ciudades', '2021-01-05'),
  (2, '/files/mayoristas_marzo_8_2017.xlsx', p_name, 'excel', 'anexo', '2017-03-07'), (3, '/files/mayoristas_' || p_partkey, 'Anexo - 31 de agosto', 'excel', 'anexo', '2012-08-31'),
  (4, '/files/mayoristas_julio_31_2012.xls', '31 de julio de 2012', 'excel', 'anexo', '2012-07-31'), (5, '/files/mayoristas_julio_31_2012.xls', '31 de julio de 2012', 'excel', 'anexo', '2012-07-31'),
  (5, '/files/otro' || p_partkey || '.xls', p_name, 'excel', NULL, NULL)) v(k, href, text, kind, category, date) WHERE p_partkey % 6 = v.k""")
def page_files(spark, sf_dir):
    one = lambda k: F.expr(f"case p_partkey % {len(_PAGES)} {' '.join(f'when {n} then {p[k]}' for n, p in enumerate(_PAGES))} end")
    # Parts are few and short, so few tasks would read all their pages.
    part = Views(spark, sf_dir).table("part").repartition("p_partkey").withColumn("k", F.col("p_partkey").cast("string"))
    url = F.concat(F.lit("https://example.org"), F.get(F.array(*[F.lit(p[0]) for p in _PAGES]), (F.col("p_partkey") % len(_PAGES)).cast("int")))
    pages = part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), one(1).alias("html"), one(2).cast("date").alias("target"))
    return links.page_files(pages).withColumn("date", F.col("date").cast("string"))


@registry.query("L9_standard_key", r"""
SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(translate(lower(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
  'Medell¡n', 'Medellín'), 'Bogot ', 'Bogotá'), 'Bogot', 'Bogotá'), 'Bogota', 'Bogotá'), 'BogotÃ¡', 'Bogotá'), 'Ã¡', 'á'), 'Ã©', 'é'), 'Ã­', 'í'), 'Ã³', 'ó'), 'Ãº', 'ú'), 'Ã±', 'ñ'), 'Ã', 'í'), '¡', 'í'), '¢', 'ó'), '£', 'ú')),
  '{a}', '{p}'), '[ \t\n\r\f\v]+', ' ', 'g')), '[^\p{L}\p{N}_\s-]', '', 'g'))) AS digest FROM documents""".replace("{a}", fn.ACCENTED.replace("'", "''")).replace("{p}", fn.PLAIN.replace("'", "''")))
def standard_key(spark, sf_dir):
    return Views(spark, sf_dir).table("documents").select("doc_id", F.md5(names.standard_key(F.col("text"))).alias("digest"))

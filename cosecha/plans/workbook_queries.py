"""Queries over workbook layouts: typed sheets built from the tables, read by the layouts, beside plain SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cosecha.functions.text import MONTHS
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views
from cosecha.sources import daily, layouts
from cosecha.sources.workbooks import date_cell, number_cell, text_cell

registry = Registry()

# One order is a workbook, its lines are the rows below the head.
_LINES = """
lines AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS nth
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _lines(spark, sf_dir: str):
    v = Views(spark, sf_dir)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    lines = v.table("lineitem").select("l_orderkey", *order).join(v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type"), "l_partkey")
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


def _text(value: Column | str) -> Column:
    return text_cell(F.lit(value) if isinstance(value, str) else value)


def _row(number: Column | int, *cells: Column) -> Column:
    return F.struct((F.lit(number) if isinstance(number, int) else number).cast("int").alias("row"), F.array(*cells).alias("cells"))


def _sheet(table, file: str, *rows: Column):
    """(file, row, cells): each of ``rows`` for every row of ``table``; null ones are left out."""
    return table.select(F.col(file).alias("file"), F.explode(F.array(*rows)).alias("r")).filter("r is not null").select("file", "r.*")


def _in_words(date: Column) -> Column:
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(date) - 1)
    return F.concat_ws(" de ", F.dayofmonth(date).cast("string"), month, F.year(date).cast("string"))


def _local(value: Column) -> Column:
    """A number in the local form, dots for thousands and a comma for decimals."""
    return F.translate(F.format_number(value, 2), ",.", ".,")


def _none() -> Column:
    return text_cell(F.lit(None).cast("string"))


def _daily_sheets(spark, sf_dir: str):
    """Wide daily sheets: number and text prices, several heads, footnotes, sheets without markets or categories."""
    kind = F.col("o_orderkey") % 10
    orders = Views(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    markets = F.when(kind != 0, _row(4, _text("Producto"), _text(F.concat(F.lit("Bogotá, D.C., Plaza\n"), F.col("o_custkey").cast("string"))), _text("Var %"), _text("Cali (Valle), Galería")))
    dated = F.when(kind == 2, _text(_in_words(F.col("date")))).otherwise(_none())
    heads = _sheet(
        orders, "o_orderkey", _row(1, _text("Precios al día")), F.when(kind != 2, _row(2, _none(), _text(F.concat(F.lit("Lunes "), _in_words(F.col("date")))))),
        F.coalesce(markets, _row(4, _text("Producto"), _text("Var"))), _row(5, dated, _text("Precio"), _text("Var %"), _text("Precio")), _row(99, _text("* cifras provisionales")), _row(100, _text("n.d. no disponible"), number_cell(F.lit(7.0))),
    )
    price = F.when(F.col("nth") % 3 == 0, _text("n.d.")).when(F.col("nth") % 3 == 1, number_cell(F.col("l_extendedprice"))).otherwise(_text(_local(F.col("l_extendedprice"))))
    above = F.when(F.col("l_orderkey") % 10 != 1, _row(4 + 2 * F.col("nth"), _text(F.concat(F.lit(" "), F.col("p_brand")))))
    body = _sheet(_lines(spark, sf_dir), "l_orderkey", above, _row(5 + 2 * F.col("nth"), _text(F.col("p_name")), price, _text("5 %"), _text(_local(F.col("l_quantity") + 0.5))))
    return heads.unionByName(body), orders


@registry.query("A9_daily_grid", f"""
WITH {_LINES}, orders_ AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT l_orderkey AS file, 5 + 2 * nth AS "row", p_brand AS category, p_name AS product, 'Kilogramo' AS presentation, '1 Kilogramo' AS units, 1 AS round, c.city, c.market, c.price AS min_price, c.price AS max_price
FROM lines JOIN orders_ ON l_orderkey = o_orderkey, LATERAL (VALUES
  ('Bogotá, D.C.', 'Plaza ' || o_custkey, CASE WHEN nth % 3 <> 0 AND l_extendedprice > 0 THEN l_extendedprice END), ('Cali', 'Galería', l_quantity + 0.5)) c(city, market, price)
WHERE l_orderkey % 10 > 1 AND c.price IS NOT NULL""")
def daily_grid(spark, sf_dir):
    return daily.daily_prices(_daily_sheets(spark, sf_dir)[0])


@registry.query("A9_daily_problems", f"""
WITH {_LINES}
SELECT o_orderkey AS file, CAST(NULL AS VARCHAR) AS "row", 'invalid_city_headers' AS error_type, 'Could not find or parse city headers' AS error_message FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT l_orderkey, CAST(5 + 2 * nth AS VARCHAR), 'missing_category', 'Product ''' || p_name || ''' has no category' FROM lines WHERE l_orderkey % 10 = 1
UNION ALL SELECT DISTINCT l_orderkey, NULL, 'missing_date', 'No date available for Excel (row_date not provided)' FROM lines WHERE l_orderkey % 10 > 1 AND l_orderkey % 4 = 3""")
def daily_problems(spark, sf_dir):
    grid, orders = _daily_sheets(spark, sf_dir)
    found = daily.daily_problems(grid, orders.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 4 != 3, F.col("date")).alias("price_date")))
    return found.withColumn("row", F.col("row").cast("string"))


def _dated(rows, column: str = "price_date"):
    return rows.withColumn(column, F.col(column).cast("string"))


_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@registry.query("A14_milk_prices", f"""
WITH {_LINES}
SELECT l_orderkey AS file, 10 + nth AS "row", strftime(CASE l_orderkey % 3 WHEN 0 THEN date_trunc('month', l_shipdate) WHEN 1 THEN l_shipdate ELSE date_trunc('month', o_orderdate) END, '%Y-%m-%d') AS price_date,
  p_type AS department, CASE WHEN l_orderkey % 3 = 0 THEN {_TITLE} ELSE upper(p_name) END AS municipality,
  CASE WHEN l_orderkey % 3 = 2 THEN l_extendedprice END AS min_price, CASE WHEN l_orderkey % 3 = 2 AND nth % 2 = 0 THEN l_extendedprice + 2.25 END AS max_price, l_extendedprice + 0.5 AS avg_price
FROM lines JOIN orders ON l_orderkey = o_orderkey""")
def milk_prices(spark, sf_dir):
    kind, day = F.col("l_orderkey") % 3, F.col("l_shipdate").cast("date")
    mean, city = number_cell(F.col("l_extendedprice") + 0.5), _text(F.upper("p_name"))
    old = _row(10 + F.col("nth"), number_cell(F.year(day)), number_cell(F.month(day)), _text(F.col("p_type")), _text("05"), city, _text("05001"), mean)
    new = _row(10 + F.col("nth"), date_cell(day), _text(F.col("p_type")), _text("05"), city, _text("05001"), mean)
    high = F.when(F.col("nth") % 2 == 0, number_cell(F.col("l_extendedprice") + 2.25)).otherwise(_text("n.d."))
    monthly = _row(10 + F.col("nth"), _text("05"), _text(F.col("p_type")), _text("05001"), city, number_cell(F.col("l_extendedprice")), high, mean, _text("="))
    body = _sheet(_lines(spark, sf_dir), "l_orderkey", F.when(kind == 0, old).when(kind == 1, new).otherwise(monthly))
    orders = Views(spark, sf_dir).table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    month = F.initcap(F.get(F.array(*map(F.lit, MONTHS)), F.month("date") - 1))
    titles = _sheet(orders, "o_orderkey", _row(3, _none(), _text(F.concat(F.lit("Leche cruda en finca\n"), month, F.lit(" de "), F.year("date").cast("string")))))
    return _dated(layouts.milk_prices(titles.unionByName(body)))


@registry.query("A15_rice_prices", f"""
WITH {_LINES}
SELECT l_orderkey AS file, 7 + nth AS "row", strftime(CASE l_orderkey % 2 WHEN 0 THEN date_trunc('month', l_shipdate) ELSE l_shipdate END, '%Y-%m-%d') AS price_date,
  p_name AS product, p_brand AS municipality, p_type AS department, l_extendedprice AS avg_price FROM lines WHERE nth % 5 <> 4""")
def rice_prices(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    price = F.when(F.col("nth") % 5 == 4, _text("sin dato")).otherwise(number_cell(F.col("l_extendedprice")))
    place = [_text("73001"), _text(F.col("p_brand")), _text("73"), _text(F.col("p_type")), price]
    month = F.initcap(F.left(F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1), F.lit(3)))
    old = _row(7 + F.col("nth"), number_cell(F.year(day)), _text(month), _text(F.concat(F.lit(" "), F.col("p_name"))), *place)
    new = _row(7 + F.col("nth"), date_cell(day), _text(F.col("p_name")), *place)
    return _dated(layouts.rice_prices(_sheet(_lines(spark, sf_dir), "l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, old).otherwise(new))))


@registry.query("A16_supply_with_codes", f"""
WITH {_LINES}, codes AS (SELECT p_name AS name, MAX_BY(CAST(p_partkey AS VARCHAR), p_partkey) AS code FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT l_orderkey AS file, 9 + nth AS "row", 'Cali, ' || p_brand AS city_market, strftime(l_shipdate, '%Y-%m-%d') AS observation_date, CASE WHEN nth % 2 = 0 THEN '76' ELSE '' END AS department_code, '76001' AS municipality_code,
  'Valle' AS department, p_type AS municipality, 'Frutas' AS food_group, CASE WHEN l_orderkey % 2 = 0 AND nth % 3 = 0 THEN '0' || l_partkey ELSE code END AS cpc_code, p_name AS product, l_quantity + 0.25 AS quantity_kg
FROM lines LEFT JOIN codes ON p_name = name WHERE nth % 7 <> 6""")
def supply_with_codes(spark, sf_dir):
    own = F.when(F.col("nth") % 3 == 0, _text(F.concat(F.lit("'0"), F.col("l_partkey").cast("string"), F.lit("'")))).otherwise(_none())
    first = [_text(F.concat(F.lit("Cali, "), "p_brand")), F.when(F.col("nth") % 7 == 6, _text("mal")).otherwise(date_cell(F.col("l_shipdate").cast("date")))]
    first += [F.when(F.col("nth") % 2 == 0, number_cell(F.lit(76))).otherwise(_none()), _text("'76001"), _text("Valle"), _text(F.col("p_type")), _text("Frutas")]
    last = [_text(F.col("p_name")), number_cell(F.col("l_quantity") + 0.25)]
    sheets = _sheet(_lines(spark, sf_dir), "l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, _row(9 + F.col("nth"), *first, own, *last)).otherwise(_row(9 + F.col("nth"), *first, *last)))
    part = Views(spark, sf_dir).table("part").filter("p_partkey % 2 = 0")
    table = _sheet(part.withColumn("file", F.lit(0)), "file", _row(10 + F.col("p_partkey"), _none(), _none(), _text(F.col("p_name")), _text(F.concat(F.lit(" "), F.col("p_partkey").cast("string"))), _none()))
    return _dated(layouts.with_food_codes(layouts.supply_rows(sheets), layouts.food_codes(table)), "observation_date")


@registry.query("A17_department_inputs", f"""
WITH {_LINES}
SELECT l_orderkey AS file, 9 + nth AS "row", strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS price_date, '05' AS department_code, 'Antioquia' AS department, CAST(l_partkey AS VARCHAR) AS cpc_code, p_name AS product,
  CASE WHEN nth % 2 = 0 THEN p_type END AS article, p_brand AS brand, CAST(NULL AS VARCHAR) AS registration, '50 kg' AS presentation, l_extendedprice AS avg_price FROM lines WHERE nth % 4 <> 3""")
def department_inputs(spark, sf_dir):
    return _dated(layouts.department_input_prices(_input_sheet(spark, sf_dir, [
        _text("05"), _text("Antioquia"), number_cell(F.col("l_partkey")), _text(F.col("p_name")), F.when(F.col("nth") % 2 == 0, _text(F.col("p_type"))).otherwise(_none()), _text(F.col("p_brand")), _none(), _text("50 kg"),
    ])))


def _input_sheet(spark, sf_dir: str, middle: list[Column]):
    day = F.col("l_shipdate").cast("date")
    month = F.when(F.col("nth") % 4 == 3, F.lit("mes")).otherwise(F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1))
    price = F.when(F.col("nth") % 3 == 0, _text(F.format_string("%.2f", "l_extendedprice"))).otherwise(number_cell(F.col("l_extendedprice")))
    return _sheet(_lines(spark, sf_dir), "l_orderkey", _row(9 + F.col("nth"), number_cell(F.year(day)), _text(month), *middle, price))


@registry.query("A17_municipality_inputs", f"""
WITH {_LINES}
SELECT l_orderkey AS file, 9 + nth AS "row", strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS price_date, '05' AS department_code, '05001' AS municipality_code, p_name AS product,
  CASE WHEN l_orderkey % 2 = 0 THEN p_brand END AS presentation, l_extendedprice + 0.5 AS avg_price FROM lines""")
def municipality_inputs(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    first = [number_cell(F.year(day)), _text(F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1)), _text("05"), _text("Antioquia"), _text("05001"), _text("Medellín"), _text(F.col("p_name"))]
    price = F.when(F.col("nth") % 2 == 0, number_cell(F.col("l_extendedprice") + 0.5)).otherwise(_text(_local(F.col("l_extendedprice") + 0.5)))
    wide, narrow = _row(9 + F.col("nth"), *first, _text(F.col("p_brand")), price), _row(9 + F.col("nth"), *first, price)
    return _dated(layouts.input_prices(_sheet(_lines(spark, sf_dir), "l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, wide).otherwise(narrow))))


@registry.query("A17_sheet_groups", f"""
WITH {_LINES}
SELECT l_orderkey AS file, '1.' || nth AS sheet, CASE WHEN nth % 3 <> 0 THEN 'Grupo ' || o_custkey ELSE 'Unknown' END AS input_group, CASE WHEN nth % 3 <> 0 THEN p_name ELSE '1.' || nth END AS subgroup
FROM lines JOIN orders ON l_orderkey = o_orderkey""")
def sheet_groups(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    name = F.concat(F.lit("1."), F.col("nth").cast("string"))
    orders = Views(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey")
    index = _sheet(orders, "o_orderkey", _row(1, _text("Contenido")), _row(2, _text("1."), _text(F.concat(F.lit("Grupo "), F.col("o_custkey").cast("string")))))
    index = index.unionByName(_sheet(lines, "l_orderkey", F.when(F.col("nth") % 3 != 0, _row(2 + F.col("nth"), _none(), _text(name), _text(F.col("p_name"))))))
    sheets = lines.select(F.col("l_orderkey").alias("file"), F.explode(F.array(name, F.concat(name, F.lit("x")))).alias("sheet"))
    return layouts.with_groups(layouts.data_sheets(sheets), layouts.sheet_index(index))

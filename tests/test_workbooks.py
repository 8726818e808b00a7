"""Workbooks as files: typed cells, the data source, and layouts over sheets written from the tables."""

import datetime as dt
import io
import zipfile
from xml.sax.saxutils import escape

import duckdb
import pytest
from pyspark.sql import functions as F

from cosecha.sources import daily, layouts, workbooks

SF = "/root/testdata/sf0.001"
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f"""<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="dd\\-mmm\\-yyyy"/><numFmt numFmtId="165" formatCode="&quot;dia&quot; 0.00"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>"""


def letters(k):
    return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def cell(place, value, shared):
    if isinstance(value, dt.date):
        days = (value - dt.date(1899, 12, 30)).days
        return f'<c r="{place}" s="2"><v>{days}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}" s="3"><v>{value}</v></c>'
    shared.append(value)
    return f'<c r="{place}" t="s"><v>{len(shared) - 1}</v></c>'


def workbook(sheets, active=0, date1904=False):
    """``sheets``: name to {row: cells}; None is an empty cell."""
    out, shared = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        entries, links = "", ""
        for k, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(f"{letters(j)}{r}", v, shared) for j, v in enumerate(cells) if v is not None) + "</row>" for r, cells in sorted(rows.items()))
            book.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
            entries += f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>'
            links += f'<Relationship Id="rId{k}" Type="x" Target="worksheets/s{k}.xml"/>'
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} {LINK}><workbookPr date1904="{int(date1904)}"/><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{entries}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>" for s in shared) + "</sst>")
        book.writestr("xl/styles.xml", STYLES)
    return out.getvalue()


@pytest.fixture(scope="module")
def lines():
    return duckdb.sql(f"""SELECT l_orderkey, l_extendedprice, l_quantity, CAST(l_shipdate AS DATE) AS day, p_name, p_brand FROM '{SF}/lineitem.parquet' JOIN '{SF}/part.parquet' ON l_partkey = p_partkey
      WHERE l_orderkey < 60 ORDER BY ALL""").fetchall()


def test_cells_have_the_kinds_that_the_styles_give(spark, tmp_path):
    rows = {1: ["Título", None, 1250.5, dt.date(2021, 2, 1)], 4: [True, 7, "n.d."], 5: [0.5]}
    (tmp_path / "a.xlsx").write_bytes(workbook({"uno": {1: ["x"]}, "1.2": rows}, active=1))
    (tmp_path / "b.xlsx").write_bytes(workbook({"s": {1: [dt.date(2020, 1, 1)]}}, date1904=True))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "d.txt").write_bytes(b"other")
    workbooks.register(spark)
    for found in (spark.read.format("workbook").load(str(tmp_path)), workbooks.read_workbooks(spark, str(tmp_path))):
        got = sorted(found.collect(), key=lambda r: (r["path"], r["sheet"] or "", r["row"] or 0))
        assert [(r["path"][-6:], r["sheet"], r["active"], r["row"]) for r in got] == [("a.xlsx", "1.2", True, 1), ("a.xlsx", "1.2", True, 4), ("a.xlsx", "1.2", True, 5), ("a.xlsx", "uno", False, 1), ("b.xlsx", "s", True, 1), ("c.xlsx", None, None, None)]
        kinds = [[c and (c["kind"], c["text"], c["number"], c["date"]) for c in r["cells"]] for r in got[:2]]
        assert kinds[0] == [("text", "Título", None, None), None, ("number", "1250.5", 1250.5, None), ("date", "2021-02-01", 44228.0, dt.date(2021, 2, 1))]
        assert kinds[1] == [("bool", "True", None, None), ("number", "7", 7.0, None), ("text", "n.d.", None, None)]
        assert got[4]["cells"][0]["date"] == dt.date(2024, 1, 2) and got[5]["problem"].startswith("BadZipFile")
    only = spark.read.format("workbook").option("sheets", r"\d+\.\d+").load(str(tmp_path / "a.xlsx"))
    assert {r["sheet"] for r in only.collect()} == {"1.2"}


def test_date_formats():
    yes, no = ["yyyy-mm-dd", "d/m/yy", "[$-240A]d \\de mmmm", "mmm"], ["0.00", '"day" 0', "[Red]0", "h:mm", "General", "#,##0_d", "mm:ss"]
    assert all(map(workbooks.is_date_format, yes)) and not any(map(workbooks.is_date_format, no))


def test_daily_workbooks_from_lines_agree_with_sql(spark, tmp_path, lines):
    """Number cells count as they are: a price of 1250.5 stays 1250.5."""
    orders = {}
    for order, price, quantity, _, name, brand in lines:
        orders.setdefault(order, []).append((name, brand, price, quantity))
    for order, own in orders.items():
        rows = {1: ["Precios"], 3: [None, "Lunes 28 de abril de 2014"], 4: ["Producto", "Bogotá, D.C., Corabastos", "Var %", "Cali, Cavasa"], 5: [None, "Precio", "Var %", "Precio"]}
        for k, (name, brand, price, quantity) in enumerate(own):
            rows[6 + 2 * k] = [brand]
            rows[7 + 2 * k] = [name, price, "3 %", f"{quantity:.2f}".replace(".", ",")]
        (tmp_path / f"{order}.xlsx").write_bytes(workbook({"Hoja": rows}))
    grid = workbooks.read_workbooks(spark, str(tmp_path)).filter("active").withColumn("file", F.regexp_extract("path", r"(\d+)\.xlsx", 1).cast("long"))
    found = sorted((r["file"], r["category"], r["product"], r["city"], r["market"], r["min_price"]) for r in daily.daily_prices(grid).collect())
    wanted = duckdb.sql(f"""SELECT l_orderkey, p_brand, p_name, c.city, c.market, c.price FROM '{SF}/lineitem.parquet' JOIN '{SF}/part.parquet' ON l_partkey = p_partkey,
      LATERAL (VALUES ('Bogotá, D.C.', 'Corabastos', l_extendedprice), ('Cali', 'Cavasa', l_quantity)) c(city, market, price) WHERE l_orderkey < 60 AND c.price > 0""").fetchall()
    assert found == sorted(wanted) and len(found) > 100


def test_dated_layouts_from_lines_agree_with_sql(spark, tmp_path, lines):
    rows = {10 + k: [day, "Antioquia", "05", name, "05001", price] for k, (_, price, _, day, name, _) in enumerate(lines)}
    (tmp_path / "milk.xlsx").write_bytes(workbook({"Hoja": rows}))
    rows = {8 + k: [day, name, "73001", brand, "73", "Tolima", price] for k, (_, price, _, day, name, brand) in enumerate(lines)}
    (tmp_path / "rice.xlsx").write_bytes(workbook({"Hoja": rows}))
    rows = {10 + k: ["Cali, Cavasa", day, "76", "'76001", "Valle", "Cali", "Frutas", "'01322", name, quantity] for k, (_, _, quantity, day, name, _) in enumerate(lines)}
    (tmp_path / "supply.xlsx").write_bytes(workbook({"2.1": rows, "F.T.": {1: ["x"]}}))
    grid = workbooks.read_workbooks(spark, str(tmp_path)).withColumn("file", F.regexp_extract("path", r"(\w+)\.xlsx", 1))
    of = lambda name: grid.filter(F.col("file") == name)
    milk = sorted((r["price_date"], r["municipality"], r["avg_price"]) for r in layouts.milk_prices(of("milk")).collect())
    assert milk == sorted((day, name, price) for _, price, _, day, name, _ in lines)
    rice = sorted((r["price_date"], r["product"], r["municipality"], r["avg_price"]) for r in layouts.rice_prices(of("rice")).collect())
    assert rice == sorted((day, name, brand, price) for _, price, _, day, name, brand in lines)
    supply = sorted((r["observation_date"], r["product"], r["quantity_kg"], r["cpc_code"], r["municipality_code"]) for r in layouts.supply_rows(layouts.data_sheets(of("supply"))).collect())
    assert supply == sorted((day, name, quantity, "01322", "76001") for _, _, quantity, day, name, _ in lines)


def test_daily_heads(spark):
    """The row of markets, by the date's row, the row above one of prices, and what is no market."""
    grid = [
        ("date below", 4, ["", "Bogotá, D.C., Corabastos"]), ("date below", 5, ["3 de mayo de 2020", "Precio"]), ("date below", 6, ["Frutas"]), ("date below", 7, ["Uva", "1.000"]),
        ("before the date", 1, ["Uva", "Medellín, Central"]), ("before the date", 2, ["x", "Thursday, December 25, 2025"]), ("before the date", 3, ["", "Precio", "Var %"]), ("before the date", 5, ["Frutas"]), ("before the date", 6, ["Uva", "1.000"]),
        ("no category", 1, ["", "Cali, Cavasa norte", "Precio"]), ("no category", 3, ["Uva", "1.000"]), ("no category", 4, ["*", "1"]), ("no category", 5, ["Var%", "1"]),
    ]
    rows = spark.createDataFrame(grid, "file string, row int, cells array<string>")
    heads = {r["file"]: (r["header"], [m["place"]["market"] for m in r["markets"]]) for r in daily.daily_markets(rows).collect()}
    assert heads == {"date below": (4, ["Corabastos"]), "before the date": (3, []), "no category": (1, ["Cavasa norte"])}
    problems = sorted((r["file"], r["row"], r["error_type"]) for r in daily.daily_problems(rows).collect())
    assert problems == [("before the date", None, "invalid_city_headers"), ("no category", 3, "missing_category")]


def test_literal_layout_cases(spark):
    """The cases that earlier queries dealt to all rows."""
    text = "file string, row int, cells array<string>"
    rows = [("f", 9, ["Año", "Mes"]), ("f", 10, ["2020", "enero", "05", "Antioquia", "0123", "Urea", "Urea 46", "Casa", "R1", "50 kg", "80000"]), ("f", 11, ["2020", "x", "05", "A", "", "Urea", "", "", "", "", "1"]), ("f", 12, ["2021", "Diciembre", "08", "Atlántico", "", "Cal", "", "", "", "", "12.5"]), ("f", 14, ["2021", "mayo", "08", "A", "", "Cal", "", "", "", "", ""])]
    found = sorted((r["row"], r["price_date"], r["article"], r["avg_price"]) for r in layouts.department_input_prices(spark.createDataFrame(rows, text)).collect())
    assert found == [(10, dt.date(2020, 1, 1), "Urea 46", 80000.0), (12, dt.date(2021, 12, 1), None, 12.5)]
    codes = layouts.food_codes(spark.createDataFrame([(9, ["", "", "Limón", "9", ""]), (10, ["", "", "Limón", " 01322 ", ""]), (12, ["", "", "", "1", ""])], "row int, cells array<string>"))
    assert [tuple(r) for r in codes.collect()] == [("Limón", "01322")]
    rows = [("m", 1, ["Precios, marzo de 2020"]), ("m", 2, ["2015", "enero", "Antioquia", "05", "BELLO", "05088", "900"]), ("m", 4, ["05", "Antioquia", "05001", "Medellín", "900", "1.000", "950", "="])]
    found = sorted((r["row"], r["price_date"], r["municipality"]) for r in layouts.milk_prices(spark.createDataFrame(rows, text)).collect())
    assert found == [(2, dt.date(2015, 1, 1), "Bello"), (4, dt.date(2020, 3, 1), "Medellín")]


def test_daily_problems_read_their_sheets_once(spark):
    cells = "array<string>"
    rows = [(1, 1, ["5 de enero de 2020"]), (1, 2, ["Producto", "Bogotá, D.C., Plaza", "Var", "Cali"]), (1, 4, ["Papa", "100", "", ""]), (1, 5, ["Frutas"]), (1, 6, ["Mora", "n.d.", "", "200"])]
    rows += [(2, 1, ["nada"]), (3, 30, ["Papa", "1"])]
    grid = spark.createDataFrame(rows, f"file int, row int, cells {cells}")
    dates = spark.createDataFrame([(1, None), (2, None)], "file int, price_date date")
    found = daily.daily_problems(grid, dates)
    wanted = {(1, 4, "missing_category"), (1, None, "missing_date"), (2, None, "invalid_city_headers"), (3, None, "invalid_city_headers")}
    assert {tuple(r)[:3] for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    assert [(r["product"], r["city"], r["min_price"]) for r in daily.daily_prices(grid).collect()] == [("Mora", "Cali", 200)]


def test_a_column_of_a_layout_is_worked_out_once(spark):
    grid = spark.createDataFrame([(1, 10, ["2020", "mayo", "05", "Antioquia", "05001", "Medellín", "Urea", "50 kg", "1.200"])], "file int, row int, cells array<string>")
    found = layouts.input_prices(grid)
    assert [(str(r["price_date"]), r["product"], r["avg_price"]) for r in found.collect()] == [("2020-05-01", "Urea", 1200)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("make_date") == 1

"""Grids, archives, sinks and streams on files made here."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from cosecha.sources import grids, sinks
from cosecha.streaming import feeds


def workbook(rows):
    cells = "".join(f'<row r="{k}">' + "".join(f'<c r="{chr(65 + j)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v) + "</row>" for k, row in enumerate(rows, 1))
    sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_workbook_to_daily_prices(spark, tmp_path):
    rows = [["Precios"], ["Producto", "Cali, Cavasa", "Var %", "Bogotá, Corabastos"], ["Hortalizas"], ["Acelga", "1.200", "3", "n.d."], ["Frutas"], ["Mango", "", "", "2.500,5"]]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows))
    grid = grids.read_workbooks(spark, str(tmp_path)).withColumnRenamed("path", "file")
    found = sorted((r["category"], r["product"], r["market"], r["price"]) for r in grids.daily_grid(grid).collect())
    assert found == [("Frutas", "Mango", "Bogotá, Corabastos", 2500.5), ("Hortalizas", "Acelga", "Cali, Cavasa", 1200.0)]


def test_bulletin_rows_emit_two_rounds(spark):
    rows = [("f", 1, ["VERDURAS", "", ""]), ("f", 2, ["Papa", "Bulto", "50 kg", "10", "12", "11", "13"]), ("f", 3, ["Yuca", "Kg", "1", "5", "", "6", ""])]
    grid = spark.createDataFrame(rows, "file string, row int, cells array<string>")
    found = sorted((r["product"], r["round"], r["min_price"], r["max_price"], r["category"]) for r in grids.bulletin_rows(grid).collect())
    assert found == [("Papa", 1, 10.0, 12.0, "VERDURAS"), ("Papa", 2, 11.0, 13.0, "VERDURAS"), ("Yuca", 1, 5.0, None, "VERDURAS")]


def test_zipped_files_skip_hidden_ones(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as packed:
        for name in ("x/one.pdf", "__MACOSX/two.pdf", "x/.three"):
            packed.writestr(name, name)
    assert [(r["name"], bytes(r["content"])) for r in grids.zipped_files(spark, str(tmp_path)).collect()] == [("x/one.pdf", b"x/one.pdf")]


def test_gazetteer_pads_codes(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("a\tb\tc\td\te\tf\tg\n5\tAntioquia\t5001\tMedellín\tM\t-75.5\t6.2\n")
    row = grids.read_gazetteer(spark, str(tmp_path / "g.tsv")).first()
    assert (row["department_code"], row["municipality_code"], row["latitude"]) == ("05", "05001", 6.2)


def test_insert_upsert_and_rejects(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0), (3, "d", 0)], "k long, v string, t int")
    assert sorted(r["k"] for r in sinks.insert_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(old, new, ["k"], "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([("1",), ("x",), ("99999999999",), (None,)], "p string")
    kept, rejected = sinks.split_rejects(rows, "p")
    assert kept.count() == 2
    assert sorted(r["error_type"] for r in rejected.collect()) == ["not_a_number", "overflow"]


def test_append_and_replace_by_source(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, dt.date(2024, 1, 5)), ("s2", 2, dt.date(2024, 2, 5))], "source string, v long, d date")
    sinks.append_by_month(rows, str(tmp_path / "m"), "d")
    sinks.append_by_month(rows, str(tmp_path / "m"), "d")
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "m")).groupBy("month").agg(F.count("*").alias("n")).collect()) == [2, 2]
    path = str(tmp_path / "r")
    sinks.replace_by_source(rows.drop("d"), path, "source")
    sinks.replace_by_source(spark.createDataFrame([("s1", 7)], "source string, v long"), path, "source")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 7]


def test_stream_drops_repeats_and_replaces_sources(spark, tmp_path):
    events = [(k, dt.datetime(2024, 1, 1, 0, k), 1, "view", 1.0) for k in range(5)] * 2
    frame = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.once(feeds.read_feed(spark, str(tmp_path / "in")))
    assert feeds.drain(stream, str(tmp_path / "out"), str(tmp_path / "c1")).count() == 5
    feeds.replace_sources(feeds.read_feed(spark, str(tmp_path / "in")), str(tmp_path / "by"), "event_type", str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "by")).count() == 10


def test_daily_grid_reads_columns_beyond_a_thousand(spark):
    wide = [""] * 1005
    rows = [("f", 0, ["Product", *wide, "Lima, Norte"]), ("f", 1, ["FRUTAS"]), ("f", 2, ["Mango", *wide, "1.200"]), ("f", 3, [])]
    found = grids.daily_grid(spark.createDataFrame(rows, "file string, row int, cells array<string>")).collect()
    assert [(r["category"], r["product"], r["market"], r["price"]) for r in found] == [("FRUTAS", "Mango", "Lima, Norte", 1200.0)]

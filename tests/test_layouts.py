"""Source layouts on golden rows."""

import datetime as dt

from pyspark.sql import functions as F

from cosecha.sources import layouts

SCHEMA = "file string, row int, cells array<string>"


def test_milk_in_three_layouts(spark):
    rows = [
        ("a", 11, ["2015", "Marzo", "Antioquia", "05", "Medellín", "05001", "900"]),
        ("b", 10, ["2021-05-01", "Antioquia", "05", "Medellín", "05001", "1.100"]),
        ("c", 1, ["Precio de leche, Junio de 2023"]),
        ("c", 11, ["05", "Antioquia", "05001", "Medellín", "1.000", "1.200", "1.100", "+"]),
        ("c", 12, ["05", "Antioquia", "05001", "Bello", "n.d.", "", "", ""]),
    ]
    found = {r["file"]: r for r in layouts.milk_prices(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {f: (r["price_date"], r["municipality"], r["avg_price"]) for f, r in found.items()} == {
        "a": (dt.date(2015, 3, 1), "Medellín", 900.0),
        "b": (dt.date(2021, 5, 1), "Medellín", 1100.0),
        "c": (dt.date(2023, 6, 1), "Medellín", 1100.0),
    }
    assert (found["c"]["min_price"], found["c"]["max_price"]) == (1000.0, 1200.0)


def test_rice_supply_and_inputs(spark):
    rows = [
        ("r", 1, ["2018", "Ene", "Paddy", "73001", "Ibagué", "73", "Tolima", "1.250"]),
        ("r", 2, ["2024-02-01", "Paddy", "73001", "Ibagué", "73", "Tolima", "1.300,5"]),
        ("r", 3, ["note"]),
    ]
    found = layouts.rice_prices(spark.createDataFrame(rows, SCHEMA)).orderBy("row").collect()
    assert [(r["price_date"], r["avg_price"]) for r in found] == [(dt.date(2018, 1, 1), 1250.0), (dt.date(2024, 2, 1), 1300.5)]
    rows = [
        ("s", 1, ["Cali, Cavasa", "2019-01-02", "76", "76001", "Valle", "Cali", "Frutas", "Mango", "120.5"]),
        ("s", 2, ["Cali, Cavasa", "2023-01-02", "76", "76001", "Valle", "Cali", "Frutas", "'01316'", "Mango", "80"]),
        ("s", 3, ["Total", "", "", "", "", "", "", "", "x"]),
    ]
    found = layouts.supply_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("row").collect()
    assert [(r["product"], r["cpc_code"], r["quantity_kg"]) for r in found] == [("Mango", None, 120.5), ("Mango", "01316", 80.0)]
    rows = [("i", 1, ["2022", "Abril", "05", "Antioquia", "05001", "Medellín", "Urea", "50 kg", "120.000"]), ("i", 2, ["2022", "Abril", "05", "Antioquia", "05001", "Medellín", "Urea", "90.000"])]
    found = layouts.input_prices(spark.createDataFrame(rows, SCHEMA)).orderBy("row").collect()
    assert [(r["price_date"], r["presentation"], r["avg_price"]) for r in found] == [(dt.date(2022, 4, 1), "50 kg", 120000.0), (dt.date(2022, 4, 1), None, 90000.0)]


def test_recognised_prices_in_both_languages(spark):
    payload = '[{"producto": "Papa", "precio_minimo": "1.200", "precio_maximo": "1.300"}, {"product": "Yuca", "min_price": "n.d."}, {"product": ""}]'
    rows = spark.createDataFrame([("a", payload), ("b", "no list"), ("c", None)], "file string, payload string")
    assert [(r["product"], r["min_price"], r["max_price"]) for r in layouts.recognised_prices(rows).collect()] == [("Papa", 1200.0, 1300.0)]


def test_document_names(spark):
    names = ["x/Cali, Cavasa-5-3-2014.pdf", "Tunja-31-2-2014.pdf", "Neiva.PDF"]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    found = [tuple(r[0]) for r in frame.orderBy("k").select(layouts.document_name(F.col("n"))).collect()]
    assert found == [("Cali", "Cavasa", dt.date(2014, 3, 5)), ("Tunja", None, None), ("Neiva", None, None)]

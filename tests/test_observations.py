from cosecha.functions import names
from cosecha.operators import cards, conform, observations
from cosecha.sources import sinks
from cosecha.plans.sql_surface import register_all
import pytest
from pyspark.sql import functions as F


def test_merges_follow_chains_and_end_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 9), (1, 7), (20, 21), (21, 22), (22, 20), (25, 21), (5, 5), (30, 31)]
    found = {r["loser"]: r["winner"] for r in conform.closed_merges(spark.createDataFrame(pairs, "loser long, winner long")).collect()}
    assert found == {1: 9, 2: 9, 3: 9, 21: 20, 22: 20, 25: 20, 30: 31}
    assert conform.closed_merges(spark.createDataFrame([], "loser long, winner long")).count() == 0


def test_a_row_is_never_doubled_and_empty_texts_match_nothing(spark):
    staged = spark.createDataFrame([(1, "Papa", "Cali", "", "kg", ""), (2, "Papa", "Cali", "x", None, "1"), (3, "no", "Cali", "", "", ""), (4, None, "Cali", "", "", "")], "id int, product string, city string, market string, presentation string, units string")
    products = spark.createDataFrame([("Papa", 1, 1, 1), ("Papa", 2, 2, 2)], "raw_value string, product_id int, subcategory_id int, category_id int")
    cities = spark.createDataFrame([("Cali", 7, 70)], "raw_value string, city_id int, department_id int")
    some = spark.createDataFrame([("", 99), ("x", 5), ("kg", 6), ("1", 8)], "raw_value string, id int")
    own = spark.createDataFrame([(7, 50), (7, 40)], "city_id int, market_id int")
    rows = observations.observations(staged, products, cities, some, some, some, own).orderBy("id").collect()
    assert [(r.id, r.product_id, r.market_id, r.presentation_id, r.units_id) for r in rows] == [(1, 1, 40, 6, None), (2, 1, 5, None, 8)]


def test_single_rows_and_pages(spark):
    rows = spark.range(5)
    assert cards.page(rows, [F.desc("id")], 1, 2).collect() == [(3,), (2,)]
    assert cards.single(rows.filter("id = 2")).count() == 1
    assert cards.single(rows.filter("id = 9"), required=False).count() == 0
    for bad in ("id = 9", "id < 2"):
        with pytest.raises(LookupError):
            cards.single(rows.filter(bad))


def test_exports_and_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert sinks.markdown(rows.orderBy("n")) == "| name | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |"
    with pytest.raises(ValueError):
        sinks.markdown(rows, 1)
    sinks.export_tsv(rows, f"{tmp_path}/t")
    assert sorted(map(tuple, sinks.read_tsv(spark, f"{tmp_path}/t", "name string, n int").collect()), key=str) == [("a|b", 1), (None, 2)]
    sinks.dead_letters(rows.withColumn("error_type", F.lit("bad")), f"{tmp_path}/e", "n")
    found = spark.read.parquet(f"{tmp_path}/e").orderBy("source").collect()
    assert [(r.error_type, r.source, r.retry_count, r.resolved) for r in found] == [("bad", "1", 0, False), ("bad", "2", 0, False)]


def test_all_table_functions_run(spark):
    assert len(register_all(spark, "/root/testdata/sf0.001")) == 19
    assert spark.sql("SELECT * FROM market_top_origins(1, 0, 3)").count() == 3
    assert spark.sql("SELECT * FROM watchlist_input_prices(0)").count() > 10
    assert spark.sql("SELECT origin_label(''), effective_price(NULL, 1, 2)").first() == ("Desconocido", 1.5)


def test_repairs_of_null(spark):
    row = spark.range(1).select(names.repaired(F.lit(None).cast("string")).alias("a"), names.standard_key(F.lit(None).cast("string")).alias("b")).first()
    assert (row.a, row.b) == ("", "")

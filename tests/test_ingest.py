"""Incremental ingest: the same file twice, restated and late sources, retries, and members created once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cosecha.operators import resolver
from cosecha.sources.snapshots import Store
from cosecha.streaming import ingest

DAY = dt.datetime(2020, 1, 1)
GAZETTEER = [("Cali", "Valle", "76001"), ("Bogotá, D.C.", "Bogotá", "11001"), ("Ipiales", "Nariño", "52356")]


def row(source, version, place, product, price):
    return (source, DAY + dt.timedelta(days=version), place, product, "Frutas", dt.date(2020, 1, 2), price)


@pytest.fixture()
def run(spark, tmp_path):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, parent string, code string")

    def deliver(rows, known=3):
        if rows:
            spark.createDataFrame(rows, ingest.ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
        return ingest.ingest(spark, f"{tmp_path}/incoming", str(tmp_path), gazetteer.limit(known))

    def again(known=3):
        return ingest.retry_errors(spark, str(tmp_path), gazetteer.limit(known))

    return deliver, again


def facts(store):
    return sorted((r["source"], r["price"]) for r in store.read("facts").collect())


def test_a_repeated_delivery_and_a_repeated_batch_add_nothing(spark, run, tmp_path):
    deliver, _ = run
    first = [row("a", 0, "Cali, Cavasa", "Uva", "1.000"), row("a", 0, "cali, Cavasa", " Uva ", "1.200,5"), row("b", 0, "Bogotá, D.C., Corabastos", "Uva", "n.d.")]
    store = deliver(first)
    before = {t: sorted(map(str, store.read(t).collect())) for t in ingest.TABLES}
    assert facts(store) == [("a", 1000.0), ("a", 1200.5)] and len(before["errors"]) == 1
    # Both spellings of the product are one member, the cities' two spellings are two.
    assert sorted((r["kind"], r["name"]) for r in store.read("members").collect()) == [("city", "Cali"), ("city", "cali"), ("market", "Mercado municipal de Cali"), ("market", "Mercado municipal de cali"), ("product", "Uva")]
    assert {t: sorted(map(str, deliver(first).read(t).collect())) for t in ingest.TABLES} == before
    batch = spark.createDataFrame([row("z", 9, "Cali, x", "Ajo", "5")], ingest.ROWS)
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, parent string, code string")
    assert not ingest.take(store, str(tmp_path), batch, 0, gazetteer)
    assert {t: sorted(map(str, store.read(t).collect())) for t in ingest.TABLES} == before


def test_a_later_version_replaces_its_source_and_an_older_one_does_not(run):
    deliver, _ = run
    deliver([row("a", 0, "Cali, x", "Uva", "1"), row("a", 0, "Cali, x", "Ajo", "mal"), row("b", 0, "Cali, x", "Uva", "2")])
    store = deliver([row("a", 2, "Cali, x", "Uva", "7"), row("a", 1, "Cali, x", "Uva", "6"), row("b", -1, "Cali, x", "Uva", "9")])
    assert facts(store) == [("a", 7.0), ("b", 2.0)] and store.read("errors").count() == 0
    assert sorted((r["source"], r["facts"], r["errors"]) for r in store.read("ledger").collect()) == [("a", 1, 0), ("b", 1, 0)]


def test_waiting_rows_are_tried_again_and_resolved(run):
    deliver, again = run
    store = deliver([row("a", 0, "Ipiales (Nariño), x", "Uva", "1"), row("a", 0, "Ipiales, x", "Uva", "3"), row("b", 0, "Cali, x", "Uva", "mal"), row("c", 0, "Ipiales, x", "Uva", "4")], known=2)
    assert facts(store) == [] and sorted({r["error_type"] for r in store.read("errors").collect()}) == ["non_numeric_price", "unknown_city"]
    deliver([row("c", 1, "Cali, x", "Uva", "5")], known=2)
    again()
    again()
    store = again()
    # What a later version of its source replaced is not tried; what fails is tried three times in all.
    assert facts(store) == [("a", 3.0), ("c", 5.0)]
    assert sorted((r["source"], r["tries"], r["resolved"]) for r in store.read("errors").collect()) == [("a", 2, True), ("a", 3, False), ("b", 3, False)]
    assert facts(again()) == facts(store)


def test_a_store_changes_only_touched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": "k string, v long, at long"}, {"t": "k"}, buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long, at long")
    assert store.read("t").count() == 0
    store.upsert("t", rows(*[(str(k), k, 0) for k in range(50)]), ["k"], "at")
    before = store.manifest()["tables"]["t"]
    assert store.upsert("t", rows(("7", 70, 1), ("7", 69, 0), ("new", 1, 0)), ["k"], "at", "s", 4) and not store.upsert("t", rows(("7", 0, 9)), ["k"], "at", "s", 4)
    after = store.manifest()["tables"]["t"]
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    found = {r["k"]: r["v"] for r in store.read("t").collect()}
    assert len(found) == 51 and found["7"] == 70 and found["8"] == 8
    store.vacuum()
    assert store.read("t").count() == 51
    with pytest.raises(ValueError):
        store.change({"t": ([0], rows(*[(str(k), 0, 0) for k in range(30)]))})


def test_resolver_order_parents_and_empty_values(spark):
    members = spark.createDataFrame([("m1", "Papa"), ("m2", "Papa criolla")], "member_id string, name string")
    aliases = spark.createDataFrame([("Papa  criolla", "m9"), ("PapÁ x", "m8"), ("Papá x", "m7")], "raw_value string, member_id string")
    values = [("Papa  criolla", "c1"), (" Papa criolla ", "c1"), (" PapÁ  x", "c1"), ("Ñame", "c2"), ("Ñame ", "c1"), ("", "c1"), (None, "c1"), ("papa", None)]
    made = resolver.resolve_or_create(spark.createDataFrame(values, "raw_value string, parent string"), "product", members, aliases, F.col("parent"))
    found = {r["raw_value"]: (r["member_id"], r["resolved_by"]) for r in made.found.collect()}
    assert found["Papa  criolla"] == ("m9", "alias") and found[" Papa criolla "] == ("m2", "name") and found[" PapÁ  x"] == ("m7", "alias_key")
    assert found["Ñame"] == found["Ñame "] and found["Ñame"][1] == "created" and found["papa"][1] == "created" and len(found) == 6
    assert sorted((r["name"], r["parent_id"]) for r in made.members.collect()) == [("papa", None), ("Ñame", "c1")]
    assert sorted(r["raw_value"] for r in made.aliases.collect()) == ["papa", "Ñame", "Ñame "]


def test_a_source_in_more_than_64_files_comes_whole_and_leaves_no_work_behind(spark, run, tmp_path):
    deliver, _ = run
    rows = spark.createDataFrame([row("a", 0, "Cali, x", "Uva", str(k + 1)) for k in range(66)], ingest.ROWS)
    rows.repartitionByRange(66, F.col("price").cast("int")).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/incoming")
    assert facts(deliver([])) == [("a", float(k + 1)) for k in range(66)]
    assert [(r["facts"], r["errors"]) for r in ingest.open_store(spark, str(tmp_path)).read("ledger").collect()] == [(66, 0)]
    assert not list((tmp_path / "work").iterdir())

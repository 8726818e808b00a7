import zlib

from cosecha.llm.sharding import digest, numbered, shard_of, shard_records
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, shard string"


def rows():
    return [(k, "same" if k % 3 == 0 else f"té {k}", "x") for k in range(2400)] + [(None, None, None), (5, "twice", "x"), (5, "twice", "x"), (9999, "", "x")]


def test_slots_sizes_and_growth(spark):
    found = digest(spark.createDataFrame(rows(), SCHEMA).repartition(5)).collect()
    assert len(found) == len(rows())
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert set(slots) == set(range(24))
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    moved = sum(r["grown_shard"] == 24 for r in found)
    assert 0.5 * len(rows()) / 25 < moved < 2 * len(rows()) / 25
    raw = [(d, (t or "").encode()) for d, t, _ in rows()]
    wanted = sorted((str(d), len(t) + 8, zlib.crc32(t)) for d, t in raw)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == wanted


def test_weights_decide_the_shares(spark):
    keys = spark.range(20_000)
    counts = {r["s"]: r["count"] for r in keys.select(shard_of(F.col("id"), [1, 3, 0]).alias("s")).groupBy("s").count().collect()}
    assert set(counts) == {0, 1} and abs(counts[1] / 20_000 - 0.75) < 0.02
    # A shard that goes moves only its own records.
    both = keys.select(shard_of(F.col("id"), [1, 1, 1]).alias("a"), shard_of(F.col("id"), [1, 0, 1]).alias("b"))
    assert both.filter("a != 1 and a != b").count() == 0


def test_other_columns_pass_and_empty_tables(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    assert "text" in shard_records(frame, [1.0] * 4).columns
    assert digest(frame.limit(0)).count() == 0


def test_rows_without_a_key_are_numbered_in_many_slices(spark):
    rows = spark.range(500).selectExpr("cast(null as long) as doc_id", "id as text_crc32", "0 as shard", "id % 7 as _slice", "id as _rows")
    got = numbered(rows, "shard", "doc_id").collect()
    assert sorted(r["slot"] for r in got) == list(range(500)) and all(r["_slice"] == r["_rows"] % 7 for r in got)

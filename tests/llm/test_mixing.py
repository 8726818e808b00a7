import math

from cosecha.llm.mixing import mix_sources, source_rates

SCHEMA = "doc_id long, source string, rate string, copy string"


def rows():
    return [(k, "big", "r", "c") for k in range(2700)] + [(3000 + k, "small", "r", "c") for k in range(300)] + [(4000, None, "r", "c"), (None, "big", None, None), (7, "big", "r", "c")]


def test_rates_follow_the_weights(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    rates = {r["source"]: (r["documents"], r["rate"]) for r in source_rates(docs).collect()}
    share = {s: math.sqrt(n) for s, (n, _) in rates.items()}
    for s, (n, rate) in rates.items():
        assert math.isclose(rate, share[s] / sum(share.values()) * len(rows()) / n)
    given = {r["source"]: r["rate"] for r in source_rates(docs, {"small": 1, None: 1}, size=600).collect()}
    assert given["big"] == 0 and given["small"] == 1 and given[None] == 300


def inverse(u, rate):
    """Poisson inversion, one step at a time."""
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_copies_are_poisson_and_reproducible(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = sorted((r["doc_id"] or -1, r["copy"], r["shuffle_key"]) for r in mix_sources(docs).collect())
    again = sorted((r["doc_id"] or -1, r["copy"], r["shuffle_key"]) for r in mix_sources(docs.repartition(7)).collect())
    assert first == again
    mixed = mix_sources(docs, {"small": 1.0}, size=60_000).collect()
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    mean = sum(copies.values()) / 300
    variance = sum((copies.get(3000 + k, 0) - mean) ** 2 for k in range(300)) / 300
    # A rate of 200 is drawn in steps; mean and variance agree with it.
    assert abs(mean - 200) < 5 and 140 < variance < 270
    keys = [r["shuffle_key"] for r in mixed]
    assert keys == sorted(keys)


def test_inversion_against_one_step_at_a_time(spark):
    import cosecha.llm.mixing as m
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "a", "r", "c") for k in range(500)], SCHEMA)
    draws = {r["doc_id"]: r["u"] for r in docs.select("doc_id", m._unit(F.col("doc_id").cast("string"), F.lit(0), F.lit(1).cast("long")).alias("u")).collect()}
    copies = {}
    for r in mix_sources(docs, {"a": 1.0}, size=1250).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {d: n for d, u in draws.items() if (n := inverse(u, 2.5))}


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_named_like_those_made_here_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5, 6, 7), (2, None, "y", 8, 9, 10)], "doc_id long, source string, _source string, _steps int, _table int, _copies int")
    got = mix_sources(docs, size=200.0).collect()
    assert {(r["_source"], r["_steps"], r["_table"], r["_copies"]) for r in got} == {("x", 5, 6, 7), ("y", 8, 9, 10)}

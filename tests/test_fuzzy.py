"""The fuzzy join against the ratio of all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cosecha.operators import conform


def keys():
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 16))).strip() or "q" for _ in range(80)] + ["papa criolla", "a" * 250, "ab" * 300]
    left = {n[1:] + "x" for n in names} | {n[:5] + "z" + n[5:] for n in names} | set(names) | {"papa pastusa", "platano", "a", "", "ab" * 310}
    return sorted(left), sorted({*names, ""})


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.6])
@pytest.mark.parametrize("paired", [4, 256])
def test_equals_all_pairs_at_every_threshold(spark, monkeypatch, threshold, paired):
    monkeypatch.setattr(conform, "PAIRED", paired)
    left, right = keys()
    found = conform.fuzzy_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), threshold)
    ratios = {(a, b): SequenceMatcher(None, a, b).ratio() for a in left for b in right}
    assert {(r["a"], r["b"]): r["ratio"] for r in found.collect()} == {k: v for k, v in ratios.items() if v >= threshold}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_matches_have_every_name_of_a_key(spark):
    members = spark.createDataFrame([("Papa",), ("papa",), ("Yuca",), (None,)], "name string")
    found = conform.fuzzy_matches(spark.createDataFrame([("pápa",), ("pappa",), ("zz",), (None,)], "value string"), members, 0.7)
    assert sorted((r["value"], r["name"]) for r in found.collect()) == [("pappa", "Papa"), ("pappa", "papa"), ("pápa", "Papa"), ("pápa", "papa")]


@pytest.mark.parametrize("find", [conform.fuzzy_best, conform.fuzzy_matches])
def test_a_key_is_worked_out_once_for_a_text_however_many_rows_have_it(spark, monkeypatch, find):
    worked_out = spark.sparkContext.accumulator(0)

    def key(text):
        worked_out.add(1)
        return text and text.lower()

    monkeypatch.setattr(conform, "comparison_key", F.udf(key, "string"))
    values = spark.createDataFrame([("Papa",), ("Papo",), ("zz",), (None,)] * 50, "value string").repartition(4)
    members = spark.createDataFrame([("papa",), ("Yuca",)] * 50, "name string").repartition(4)
    assert sorted((r["value"], r["name"]) for r in find(values, members, 0.7).collect()) == [("Papa", "papa"), ("Papo", "papa")]
    assert worked_out.value <= 6

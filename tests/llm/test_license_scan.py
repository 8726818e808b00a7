import random
import re

import pytest
from pyspark.sql import functions as F

from cosecha.llm import license_scan as L

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_by_words(text):
    """(n_words, starts, labels) by a plain walk over the words."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), sorted(starts), labels


def labels_without_seeds(text):
    """Bounded-error matching over all the words, without looking for pieces first."""
    words = L.as_words(text or "").decode("utf-8")
    return {n.label for n in L.NOTICES if L.bounded_error_pattern(n.words).search(words)}


def harmed(rng, words, edits):
    for _ in range(edits):
        k = rng.randrange(1, len(words) - 1)
        words = rng.choice([words[:k] + words[k + 1 :], words[:k] + rng.choice("aeé1") + words[k:], words[:k] + rng.choice("xyñ") + words[k + 1 :]])
    return words


def texts():
    rng = random.Random(7)
    filler = "la casa Über dem license mit public é 42 Apache general und the software".split()
    out = [None, "", " \n--", "MIT License", "mit\tlicense: MIT, license", "Released under the MIT Licence.", "summit license", "mit licenses apply", "é" * 50 + "mit license", "mit license" + "é"]
    for _ in range(400):
        parts = [rng.choice(filler) for _ in range(rng.randrange(0, 30))]
        notice = rng.choice(L.NOTICES).words
        parts.insert(rng.randrange(len(parts) + 1), harmed(rng, notice, rng.randrange(0, L.edits_of(notice) + 2)))
        out.append(rng.choice([" ", "\n", ", ", " - "]).join(parts))
    return out


def test_base_places_and_labels_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash")).withColumn("score", F.lit(2))
    got = {r["doc_id"]: r for r in L.digest(frame.repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        count, starts, labels = base_by_words(text)
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (count, len(starts)), text
        assert (r["first_word"], r["last_word"]) == ((starts[0], starts[-1]) if starts else (None, None)), text
        assert r["base_labels"] == ",".join(sorted(labels)), text
        assert set(r["labels"].split(",")) - {""} == labels_without_seeds(text), text
        assert (r["score"] == 1.0) if starts else (0 <= r["score"] <= 1)
    assert got[0]["n_words"] == 0 and got[0]["score"] == 0 and got[0]["labels"] == ""


def test_edits_are_found_up_to_the_bound_and_no_further():
    rng = random.Random(3)
    for notice in L.NOTICES:
        for edits in range(L.edits_of(notice.words) + 1):
            found = L.find_notices(f"so é {harmed(rng, notice.words, edits)} ends", (notice,))
            assert found["spans"] and found["spans"][0]["edits"] <= edits and found["spans"][0]["first_word"] == 2
    assert L.find_notices("mot licence")["spans"] == [] and L.find_notices("the missing license")["spans"] == []
    assert [s["base"] for s in L.find_notices("mit license mit license mit licence")["spans"]] == [True, True, False]


@pytest.mark.parametrize("unit", ["mit license ", "icense", "a", "é", "-"])
def test_very_long_texts(unit):
    text = unit * (4_000_000 // len(unit))
    assert (L.find_notices(text)["n_words"], len([s for s in L.find_notices(text)["spans"] if s["base"]])) == {
        "mit license ": (2 * (4_000_000 // 12), 4_000_000 // 12),
        "-": (0, 0),
    }.get(unit, (1, 0))


def test_other_columns_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "mit license", None), (1, "mit license", None)], "license_scan long, text string, spans date")
    got = L.scan(frame).collect()
    assert len(got) == 2 and got[0]["license_scan"] == 1 and got[0]["_license_scan"]["spans"][0]["last_word"] == 1
    assert L.scan(frame.limit(0)).count() == 0 and L.digest(frame.withColumnRenamed("license_scan", "doc_id").limit(0)).count() == 0

from collections import Counter

import pytest
import xxhash
from cosecha.llm import fingerprints
import hashlib
import random

from cosecha.llm.fingerprints import fingerprint_with_edits, likeness, with_fingerprint
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, own string"


def sample():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(100, 400))), "x") for k in range(0, 60, 3)]
    rows += [(100, None, None), (101, "", "x"), (102, "one", "x"), (103, rows[0][1], "x"), (103, rows[0][1], "x"), (None, rows[1][1], "x")]
    rows += [(104, "la la " * 500, "x"), (105, "é" * 3000, "x"), (106, " \n\t", "x"), (107, "ñandú 😀 " * 60, "x")]
    return rows


def test_edited_texts_and_likeness(spark):
    rows = sample()
    found = fingerprint_with_edits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    distinct = sorted({(d, t or "") for d, t, _ in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = {distinct[k]: distinct[(k + 1) % len(distinct)][1] for k in range(len(distinct))}
    texts = {d: t for d, t in distinct}
    by_text = {}
    for r in found:
        text = texts[r["doc_id"]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[(r["doc_id"], text)][:cut]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if len(text.split()) >= 100 and len(set(text.split())) > 50:
            assert r["near_edited"] > 0.05
    assert len({r["fingerprint"] for r in found if len(texts[r["doc_id"]].split()) > 99}) >= 20


def test_order_matters_and_nothing_runs_in_python(spark):
    a = " ".join(f"w{k}" for k in range(300))
    b = " ".join(f"w{k}" for k in [*range(150, 300), *range(150)])
    frame = spark.createDataFrame([(a, a, b)], "a string, same string, moved string")
    for name in ("a", "same", "moved"):
        frame = with_fingerprint(frame, name, f"{name}_print")
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    row = frame.select(likeness(F.col("a_print"), F.col("same_print")).alias("same"), likeness(F.col("a_print"), F.col("moved_print")).alias("moved")).first()
    assert row["same"] == 1.0
    assert 0.2 < row["moved"] < 0.9


def test_empty_table(spark):
    assert fingerprint_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_and_unspaced_near_copies_are_alike(spark):
    rng = random.Random(9)
    unspaced = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    emoji = "".join(chr(0x1F300 + rng.randrange(300)) for _ in range(200))
    pairs = [("the red house", "the red mouse"), ("good morning", "good morming"), ("ab", "ab c"), (unspaced, unspaced[:3] + "X" + unspaced[3:]), (emoji, emoji[:5] + emoji[6:])]
    pairs += [("the red house", "zuvy qik"), (unspaced, emoji), (" one  two\n", "one two"), (" ", "one"), ("\t", None)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    for name in ("a", "b"):
        frame = with_fingerprint(frame, name, f"{name}_print")
    alike = [r[0] for r in frame.orderBy("k").select(likeness(F.col("a_print"), F.col("b_print"))).collect()]
    assert min(alike[:3]) > 0.1 and min(alike[3:5]) > 0.5
    assert max(alike[5:7]) < 0.1 and alike[7:] == [1.0, 0.0, 1.0]


def _top_bits(*parts):
    """Spark's xxhash64 of the parts, its leading 39 bits."""
    seed = 42
    for part in parts:
        raw = part.encode() if isinstance(part, str) else part.to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed >> 25


def _sketch(text, k=5, sample=128, bits=6, size=2):
    """{place: hashes of its tuple} by listing every k-mer with its number."""
    folded = " ".join(text.split())
    if not folded:
        return {}
    padded = " " * (k - 1) + folded + " " * (k - 1)
    hashes = [_top_bits(padded[i : i + k]) for i in range(len(padded) - k + 1)]
    largest = sorted(set(hashes))[:sample][-1]
    seen, items = Counter(), []
    for place, value in enumerate(h for h in hashes if h <= largest):
        seen[value] += 1
        items.append((_top_bits(value, seen[value]), place))
    out = {}
    for value, place in sorted(items):
        out.setdefault(value >> (39 - bits), []).append((place, value))
    return {b: tuple(v for _, v in sorted(found[:size])) for b, found in out.items()}


def _alike(a, b):
    either = a.keys() | b.keys()
    return 1.0 if not either else sum(a.get(p) == b.get(p) for p in either) / len(either)


def test_likeness_matches_brute_force_and_follows_edits(spark):
    rng = random.Random(2)
    letters = {"latin": "abcdefghij   ", "unspaced": "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"}
    rows = []
    for script, alphabet in letters.items():
        base = [rng.choice(alphabet) for _ in range(400)]
        for edits in (0, 1, 5, 20, 80, 300):
            other = list(base)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[], [rng.choice(alphabet)], [rng.choice(alphabet)] * 2])
            rows.append((script, edits, "".join(base), "".join(other)))
        rows.append((script, -1, "".join(base), "".join(base[200:] + base[:200])))
    rows += [("short", 0, "ab", "ab"), ("short", 1, "ab", "ac"), ("repeats", 0, "ab " * 90, "ab " * 91), ("empty", 0, "", " "), ("empty", 1, "", "x")]
    df = spark.createDataFrame(rows, "script string, edits int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = {(r["script"], r["edits"]): r["l"] for r in df.select("script", "edits", fingerprints.likeness(df["fa"], df["fb"]).alias("l")).collect()}
    for script, edits, a, b in rows:
        assert got[script, edits] == pytest.approx(_alike(_sketch(a), _sketch(b))), (script, edits)
    for script in letters:
        assert got[script, 0] == 1 and got[script, 1] > 0.8
        assert got[script, 1] >= got[script, 20] > got[script, 300] and got[script, 5] > got[script, 80]

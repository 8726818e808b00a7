import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cosecha.llm import spelling_variants as S

SCHEMA = "doc_id long, text string"


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(words):
    forms, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_apart(v, w)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out)


def rows():
    rng = random.Random(5)
    words = ["casas", "casass", "cassas", "acasas", "Über", "überall", "uberall", "Élanç", "banana", "bananas", "bananna", "aaaaa", "aaaaaa", "aaaaaaa", "x" * 300, "x" * 301, "niños", "ninos", "ninós", "zebra", "zebras", "zebrás"]
    for w in list(words):
        for _ in range(4):
            k = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcné÷×") + w[k:], w[:k] + rng.choice("abcné") + w[k + 1 :]]))
    weights = [1 / (k % 23 + 1) ** 2 for k in range(len(words))]
    out = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(60)))) for k in range(300)]
    return out + [(None, "casas casas"), (None, None), (7, None), (8, ""), (9, "12 -- 3"), (10, "casas " * 3000), (11, "zebra zebra"), (11, "zebra zebra")]


def test_equals_brute_force(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(6)
    got = S.digest(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = brute(counted(rows()))
    assert len(wanted) > 50 and any(r[1] is not None and r[2] != r[1] for r in wanted)
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_hash_collisions_change_nothing(spark):
    words = counted(rows())
    table = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(words.items())], "id long, word string, n long")
    # Keys of four values: nearly every word shares one with words that it is not near to.
    rough = S.deletion_keys(table).withColumn("key", F.col("key") % 4)
    got = {r["word"]: r["n_near"] for r in S.near_words(table, rough).collect()}
    assert got == {r[0]: r[4] for r in brute(words) if r[4]}


def test_deletion_hashes_follow_the_strings():
    words = ["casas", "casass", "ab", "a", "", "ññññ", "x" * 1000]
    keys, places, number = S.deletion_hashes(words)
    found = {}
    for key, place, k in zip(keys.tolist(), places.tolist(), number.tolist()):
        word = words[k]
        found.setdefault(word if place < 0 else word[:place] + word[place + 1 :], set()).add(key)
    assert all(len(v) == 1 for v in found.values()) and len({next(iter(v)) for v in found.values()}) == len(found)
    assert len(keys) == sum(map(len, words)) + len(words)


def test_shared_keys_across_batches():
    import pyarrow as pa

    keys, ids = np.array([1, 1, 2, 3, 3, 3, 4, 4]), np.array([1, 1, 5, 7, 7, 8, 9, 2])
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(np.zeros(len(keys[k : k + size]), np.int32)), pa.array(ids[k : k + size])], names=["key", "place", "id"]) for k in range(0, 8, size)]
        assert [i for b in S._shared(iter(batches)) for i in b.column(0).to_pylist()] == [7, 7, 8, 9, 2]


def test_long_texts_and_words(spark):
    letters = "".join(random.Random(1).choices("abcdefgh", k=60_000))
    data = [(1, f"{letters} " * 4 + f"{letters[:100]}z{letters[100:]} " * 9), (2, "wörter " * 400_000)]
    got = {r["word"]: r for r in S.spelling_variants(S.word_counts(spark.createDataFrame(data, SCHEMA))).collect()}
    assert got[letters]["root"] == letters[:100] + "z" + letters[100:] and got[letters]["n_near"] == 1 and got["wörter"]["n"] == 400_000


def test_empty_tables(spark):
    assert S.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.digest(spark.createDataFrame([(1, None), (2, "ab")], SCHEMA)).count() == 0

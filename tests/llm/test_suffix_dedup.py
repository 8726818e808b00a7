import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cosecha.llm import suffix_dedup as sd

L = 400


def brute(docs, first_stays=False):
    """{row number: (n_bytes, n_removed, n_spans, kept sha256)} by listing every window."""
    seen = Counter()
    first = {}
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    for k in order:
        raw = (docs[k][1] or "").encode()
        for s in range(len(raw) - L + 1):
            w = raw[s : s + L]
            seen[w] += 1
            first.setdefault(w, (k, s))
    out = {}
    for k, (_, text) in enumerate(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - L + 1):
            w = raw[s : s + L]
            if seen[w] > 1 and (not first_stays or first[w] != (k, s)):
                gone[s : s + L] = b"\1" * L
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [text(r.randint(5, 300)) for _ in range(30)]
    passage, base = text(90), text(200)
    docs += [text(r.randint(0, 60)) + passage[r.randint(0, 60) :] + text(r.randint(0, 60)) for _ in range(12)]
    docs += [base, base, base[:500] + "X" + base[501:], base[300:], base[:-300], base + base, "ab" * 700, "a" * 900, "", None, " ", "x" * 400]
    docs += ["é" * 450, base[:399], base[:400]]
    r.shuffle(docs)
    return [(k * 3, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("first_stays", [False, True])
@pytest.mark.parametrize("hot", [2, 256])
def test_removed_bytes_match_brute_force(spark, first_stays, hot):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sd.remove_repeats(df, L, first_stays, hot_cell=hot).collect()}
    want = brute(docs, first_stays)
    for k, (doc_id, _) in enumerate(docs):
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) == want[k], doc_id


def test_hot_edges_and_long_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    docs = [(k, text(20 + k % 7) + passage + text(30)) for k in range(40)]
    long = text(1500)
    docs += [(100, long), (101, "Z" + long[2000:9000] + text(10))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    old = sd.CHUNK_BYTES
    sd.CHUNK_BYTES = 3000
    try:
        for hot in (5, 256):
            got = {x.doc_id: x for x in sd.remove_repeats(df, L, False, hot_cell=hot).collect()}
            for k, (doc_id, _) in enumerate(docs):
                x = got[doc_id]
                assert (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept_bytes)).hexdigest()) == want[k]
    finally:
        sd.CHUNK_BYTES = old


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, cell string")
    assert sd.remove_repeats(empty).count() == 0
    t = "word " * 120
    df = spark.createDataFrame([(None, t, "p", 1), (7, t, "q", 2), (7, t, "q", 2), (8, None, None, None)], "doc_id long, text string, cell string, begin int")
    rows = sd.remove_repeats(df, first_stays=False).collect()
    assert sorted((x.cell or "", x.n_removed) for x in rows) == [("", 0), ("p", 600), ("q", 600), ("q", 600)]
    assert {"doc_id", "text", "cell", "begin", "kept_bytes"} <= set(rows[0].asDict())
    assert set(sd.digest(df).columns) == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}


def test_longest_previous_factors_match_brute_force():
    r = random.Random(3)
    for _ in range(40):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        cells = [r.randint(0, 1) for _ in texts]
        cells.sort()
        depth = r.choice([1, 3, 6, 7, 20])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.array(cells), sizes)
        levels = sd.suffix_levels(data, ends, owner, depth)
        places = np.lexsort((np.arange(len(data)), levels[-1][1]))
        common = sd.common_prefixes(places[:-1], places[1:], data, ends, owner, levels)
        found, source = sd.longest_previous_factors(places, common)
        raw = data.tobytes()

        def shared(i, j):
            k = 0
            while k < depth and i + k < ends[i] and j + k < ends[j] and raw[i + k] == raw[j + k]:
                k += 1
            return k if owner[i] == owner[j] else 0

        for at, (place, factor, by) in enumerate(zip(places.tolist(), found.tolist(), source.tolist(), strict=True)):
            assert factor == max((shared(place, j) for j in range(place)), default=0), at
            assert factor == 0 or (places[by] < place and shared(place, int(places[by])) >= factor)


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "word " * 120, "p", 3)], "doc_id long, text string, _ranges string, _row_key int")
    row = sd.remove_repeats(df, first_stays=True).first()
    assert (row["_ranges"], row["_row_key"]) == ("p", 3) and row["n_removed"] > 0

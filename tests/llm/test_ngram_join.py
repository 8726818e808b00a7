import random
import re

import numpy as np
import pytest

from cosecha.llm import ngram_join as nj
from cosecha.llm.components import connected


def shingles(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)])


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), least.get(find(k))) for k, (d, _) in enumerate(docs)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeÉñA") for _ in range(r.randint(1, 6))) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = [" ".join(text(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 60]))) for _ in range(60)]
    for size in (9, 10, 12, 17, 25, 40, 90, 300):
        base = text(size)
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, max(1, size // 40))):
                where = r.randrange(len(copy))
                copy[where : where + 1] = r.choice([[], text(1), text(2)])
            cut = r.randint(0, max(1, size // 14))
            docs.append("  ".join(copy[cut:]) if r.random() < 0.5 else "\t".join(copy))
    docs += [None, "", "  \n", "one", "ONE", "one two", "one  TWO", "\x1cone", "a " * 50, "a " * 90]
    ids = [k * 2 + 1 for k in range(len(docs))]
    r.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, block):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = nj.jaccard_components(df, block=block).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(docs)


def test_edge_rows(spark):
    docs = [(None, "p q r s t"), (4, "p q r s t"), (9, "P Q r s t"), (9, "P Q r s t"), (2, None), (None, "")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, set_key int, component_id string")
    got = nj.jaccard_components(df).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(docs)
    assert nj.jaccard_components(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_complementary_texts_are_different_words(spark):
    """Words whose polynomial hashes modulo a power of two collide under any base."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    docs = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    got = nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 2)]


def test_copies_send_their_cells_once_a_task(spark):
    text = " ".join(f"w{k}" for k in range(300))
    one = spark.createDataFrame([(0, text), (1, text + " x")], "doc_id long, text string").coalesce(1)
    many = spark.createDataFrame([(k, text + " x" * (k % 2)) for k in range(1000)], "doc_id long, text string").coalesce(1)
    assert nj.shared_cells(many, 4, 85, 3).count() == nj.shared_cells(one, 4, 85, 3).count() > 50


def test_linked_sets_have_a_rare_element_alike():
    """Sets at and just above the threshold, of equal and of most unequal sizes, under counters that many elements share."""
    rng = np.random.default_rng(5)
    lows = np.array(nj.size_bands(), np.int64)
    for trial in range(400):
        percent = int(rng.choice([60, 80, 85, 95]))
        n = int(rng.integers(1, 300))
        m = int(rng.integers(n, max(n + 1, n * 100 // percent + 1)))
        shared = -(-percent * (n + m) // (100 + percent))
        if shared > n:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64))[: n + m - shared]
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
        often = rng.integers(2, 2 + int(rng.choice([1, 5, 1000])), nj.COUNTERS).astype(np.int32)
        assert len(np.intersect1d(a, b)) == shared and len(b) == m
        keys = [np.concatenate(nj._rare_elements(x, often, lows, percent)) for x in (a, b)]
        assert len(np.intersect1d(*keys)), (trial, percent, n, m)


def test_near_copies_too_far_apart_meet_nowhere(spark, monkeypatch):
    """Copies of a text, each with changes of its own: those with many changes link with none, and rows that meet follow the number of sets."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(360):
        words = list(base)
        for at in rng.choice(37, 1 if k % 12 == 0 else 9, replace=False) * 4 + 1:
            words[at] = f"x{k}-{at}"
        texts.append((k, " ".join(words)))
    sent, unit_members = [], nj._unit_members

    def counted(sets, units, *rest):
        sent.append(units.count())
        return unit_members(sets, units, *rest)

    monkeypatch.setattr(nj, "_unit_members", counted)
    got = nj.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), block=64).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(texts)
    assert len({x.component_id for x in got}) == 331
    assert sum(sent) <= 3 * len(texts), sent

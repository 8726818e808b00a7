import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from cosecha.llm.bpe import read_ranks
from cosecha.llm.tables import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def sample():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvéñ") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [" ".join(words(rng.randint(60, 200))) for _ in range(40)]
    near = texts[0].split()
    near[5] = "changed"
    texts += [texts[1], texts[1], " ".join(near)]
    passage = " ".join(words(55))
    for k in (20, 25, 30):
        texts[k] = texts[k] + " " + passage + " " + texts[k][:1]
    texts += ["12 34 !!", "", None, "日本"]
    rows = [(k, t, "en" if k < 40 else None, f"s{k % 3}", len(t or ""), "n") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[7], "en", "s1", 5, None)], passage


@pytest.fixture(scope="module")
def steps(spark):
    rows, passage = sample()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {"documents": rows}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        out[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
    return out, passage


def test_language_id_drops_texts_without_a_language(steps):
    kept = {r["doc_id"] for r in steps[0]["language_id"]}
    assert kept == {None, *range(43)}


def test_one_of_each_group_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[0]["language_id"]]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    sets = [(d, t, shingles(t)) for d, t in rows]
    first = {}
    for d, t, s in sets:
        alike = [e for e, _, o in sets if len(s & o) >= 0.8 * len(s | o) and e is not None]
        first[d, t] = min(alike) if alike else None
    wanted = sorted({(d, t) for (d, t), f in first.items() if d is None or f == d}, key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in steps[0]["ngram_jaccard_join"]), key=repr) == wanted


def test_later_copies_of_a_passage_go(steps):
    found, passage = steps
    before = {r["doc_id"]: r["text"] for r in found["ngram_jaccard_join"]}
    after = {r["doc_id"]: r["text"] for r in found["suffix_array_dedup"]}
    assert passage in after[20] and passage[:120] not in after[25] and passage[:120] not in after[30]
    for doc, text in after.items():
        if doc not in (25, 30, 7, None):
            assert text == before[doc]
    length = pipeline.PASSAGE_BYTES
    for r in found["suffix_array_dedup"]:
        assert r["n_chars"] == len(r["text"])
    # No string of that length is left twice.
    seen = {}
    for doc, text in after.items():
        raw = text.encode()
        for k in range(len(raw) - length + 1):
            assert seen.setdefault(raw[k : k + length], (doc, k)) == (doc, k)


def test_mixing_repeats_whole_documents(steps):
    known = {(r["doc_id"], r["text"]) for r in steps[0]["suffix_array_dedup"]}
    mixed = [(r["doc_id"], r["text"]) for r in steps[0]["mix_sources"]]
    assert mixed and set(mixed) <= known


def test_encoding_agrees_with_the_library(steps):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = read_ranks(lines)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in steps[0]["mix_sources"]}
    assert len(steps[0]["byte_level_bpe"]) == len(steps[0]["mix_sources"])
    for r in steps[0]["byte_level_bpe"]:
        ids = library.encode_ordinary(texts[r["doc_id"], r["n_chars"]])
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r["n_tokens"] == len(ids) and r["round_trip"]


def test_stage_names_and_the_entry():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "mix_sources", "byte_level_bpe"]
    assert pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
    assert docs.count() == 0

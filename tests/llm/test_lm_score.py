import math
import re
from collections import Counter

import pytest

from cosecha.llm import lm_score
from cosecha.llm.lm_score import SMOOTHING, digest, token_hashes, with_score

SCHEMA = "doc_id long, text string, score string"


def rows():
    good = [(k, "the river runs to the sea and the sea is deep " * (k % 3 + 1), "x") for k in range(20)]
    bad = [(k, "buy cheap pills now buy now cheap cheap click " * (k % 3 + 1), "x") for k in range(20, 40)]
    return good + bad + [(50, None, None), (51, "", "x"), (52, "?!", "x"), (None, "the sea", "x"), (3, "the sea", "x")]


def labels(spark):
    return spark.createDataFrame([(k, 1) for k in range(10)] + [(k, 0) for k in range(20, 30)] + [(None, 1)], "doc_id long, quality int")


def words(text):
    return re.findall(r"\w+", (text or "").lower())


class ByHand:
    """The models of (text, is_target), word by word."""

    def __init__(self, docs):
        self.word, self.context, self.pair = ([Counter(), Counter()] for _ in range(3))
        for text, target in docs:
            tokens = words(text)
            for side in (0, 1) if target else (1,):
                self.word[side].update(tokens)
                self.context[side].update(["<s>", *tokens[:-1]] if tokens else [])
                self.pair[side].update(zip(["<s>", *tokens[:-1]], tokens, strict=bool(tokens)))
        self.tokens = [sum(c.values()) for c in self.word]
        self.scale = [1.0, self.tokens[0] / self.tokens[1] if self.tokens[0] else 1.0]

    def chance(self, side, before, word):
        scale = self.scale[side]
        unigram = (self.word[side][word] * scale + 1) / (self.tokens[side] * scale + len(self.word[1]) + 1)
        return (self.pair[side][before, word] * scale + SMOOTHING * unigram) / (self.context[side][before] * scale + SMOOTHING)

    def losses(self, text):
        tokens = words(text)
        return [sum(-math.log2(self.chance(side, b, w)) for b, w in zip(["<s>", *tokens[:-1]], tokens, strict=True)) / len(tokens) for side in (0, 1)]


def test_models_and_losses_by_hand(spark):
    docs = [(t, k < 20) for k, (_, t, _) in enumerate(rows())]
    hand = ByHand(docs)
    for before in ("<s>", "the", "cheap", "never seen"):
        for side in (0, 1):
            assert sum(hand.chance(side, before, w) for w in [*hand.word[1], "unknown word"]) == pytest.approx(1)
    corpus = spark.createDataFrame(docs, "text string, is_target boolean").repartition(3)
    texts = ["the sea is cheap", "Ünknown the SEA", "pills"]
    found = with_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), corpus).orderBy("doc_id").collect()
    for row, text in zip(found, texts, strict=True):
        wanted = hand.losses(text)
        assert (row["target_loss"], row["background_loss"]) == (pytest.approx(wanted[0], rel=1e-9), pytest.approx(wanted[1], rel=1e-9))
        assert row["score"] == pytest.approx(wanted[1] - wanted[0]) and row["n_tokens"] == len(words(text))


def test_words_are_those_of_the_regular_expression():
    texts = ["Das Ist größer_1 ÀÉ", None, "", "日本 x", "a" * 300 + " b", "İi ΑΣ. ٣ ½ foo-bar"]
    doc, value = token_hashes(texts)
    wanted = [(k, w) for k, t in enumerate(texts) for w in words(t)]
    assert doc.tolist() == [k for k, _ in wanted]
    named = {}
    for (_, w), v in zip(wanted, value.tolist(), strict=True):
        assert named.setdefault(w, v) == v
    assert len(set(named.values())) == len(named)


def test_targets_score_higher_and_edge_cases(spark):
    found = digest(spark.createDataFrame(rows(), SCHEMA), labels(spark)).collect()
    assert len(found) == len(rows())
    score = {r["doc_id"]: r["score"] for r in found if r["n_tokens"] > 2}
    # Documents that no label names follow their kind.
    assert min(score[k] for k in range(10, 20)) > 0 > max(score[k] for k in range(30, 40))
    assert all(r["score"] is None and r["n_tokens"] == 0 for r in found if r["doc_id"] in (50, 51, 52))


def test_no_target_and_no_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert digest(docs, labels(spark).limit(0)).count() == len(rows())
    assert digest(docs.limit(0), labels(spark)).count() == 0


def test_rare_words_and_bigrams_keep_their_own_counts(spark):
    # More words than any fixed vocabulary; each frequent one and each rare one is its own word.
    filler = [" ".join(f"f{k} f{k}" for k in range(at, at + 1000)) for at in range(0, 60_000, 1000)]
    rare = "zz1 zz2 zz1 zz3"
    docs = [(k, t, "x") for k, t in enumerate([*filler, rare, rare])]
    found = {r["doc_id"]: r for r in digest(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([(60, 1), (0, 1)], "doc_id long, quality int")).collect()}
    wanted = ByHand([(t, k in (0, 60)) for k, t, _ in docs]).losses(rare)
    for doc in (60, 61):
        assert (found[doc]["target_loss"], found[doc]["background_loss"]) == (pytest.approx(wanted[0], rel=1e-9), pytest.approx(wanted[1], rel=1e-9))
        assert found[doc]["n_tokens"] == 4


def test_many_groups_and_parts_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    one = sorted(digest(docs, labels(spark)).collect(), key=key)
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 100)
    monkeypatch.setattr(lm_score, "PART_KEYS", 20)
    many = sorted(digest(docs.repartition(3), labels(spark)).collect(), key=key)
    for a, b in zip(one, many, strict=True):
        assert key(a) == key(b) and (a["score"] is None) == (b["score"] is None)
        assert a["score"] is None or a["score"] == pytest.approx(b["score"])


def test_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", True, 5), (1, "a b", True, 6), (None, "c", None, 7)], "doc_id long, text string, is_target boolean, _row int")
    got = with_score(docs).collect()
    assert sorted((r["_row"], r["n_tokens"]) for r in got) == [(5, 2), (6, 2), (7, 1)] and got[0].asDict().keys() >= {"is_target", "_row", "score"}


def test_columns_named_like_those_made_inside_pass_through(spark):
    rows = [(1, "uno dos tres", "a", 5), (2, "uno dos", "b", 6), (None, None, "c", 7), (2, "uno dos", "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _target string, _lm_row long")
    got = lm_score.score_documents(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert sorted((r["_target"], r["_lm_row"]) for r in got) == [("a", 5), ("b", 6), ("b", 6), ("c", 7)]
    plain = lm_score.score_documents(docs.select("doc_id", "text"), spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert sorted(str(r["score"]) for r in got) == sorted(str(r["score"]) for r in plain)

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cosecha.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb"))
OURS = bpe.BytePairEncoder(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(next(OURS.encode_all([text])), "<u4").tolist()


def agree(text):
    got = ids(text)
    assert got == THEIRS.encode_ordinary(text)
    assert OURS.decode(np.array(got, "<u4").tobytes()) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  '\n\tstthe aeéñ12")), max_size=80))
def test_same_ids_as_tiktoken(text):
    agree(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "<|endoftext|>", "é" * 999, "it's  John'S\r\n\n x", "\x1c\x85　 a", "日本語テキスト" * 50])
def test_hard_texts(text):
    agree(text)


def test_random_long_pretokens():
    r = random.Random(3)
    for size in (200, 2000, 20000):
        agree("".join(r.choice("abcdefghijklmnopqrstuvwxyzthein") for _ in range(size)))


def test_lower_rank_made_by_a_merge():
    ranks = {bytes([k]): k + 10 for k in range(256)} | {b"abc": 3, b"ab": 7, b"bc": 300, b"abcabc": 1, b"aa": 5, b"aaaa": 2}
    ours = bpe.BytePairEncoder(ranks, r"\S+|\s+")
    theirs = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["".join(r.choice("aabbc ") for _ in range(r.randint(1, 60))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode_all(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "ENCODE_BYTES", 300)
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdxyz") for _ in range(r.choice([1, 3, 90]))) for _ in range(r.randint(0, 30))) for _ in range(60)]
    ours = bpe.BytePairEncoder(RANKS, P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode_all(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


def test_dataframe(spark):
    texts = ["Hello world", None, "", "é ñ " * 400, "Hello world"]
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(texts)] + [(None, "Hi", None, None)], "doc_id long, text string, ids string, n_tokens int")
    for x in bpe.digest(df, PATH, P.PATTERN).collect():
        want = THEIRS.encode_ordinary(texts[x.doc_id] or "" if x.doc_id is not None else "Hi")
        text = (texts[x.doc_id] or "") if x.doc_id is not None else "Hi"
        assert (x.n_tokens, x.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    rows = bpe.encode(df, PATH, P.PATTERN).collect()
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in rows) and rows[0].n_tokens == 5
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0

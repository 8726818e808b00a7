"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents and one of all documents (the background),
share one vocabulary: every word of the corpus, so that it grows with the corpus. They
are matched in form and in weight: the same smoothing, with the background's counts
scaled to the target's number of tokens. A token's loss is -log2 of its probability after
the word before it (a start of its own before the first); a document's score is the mean
over its tokens of background loss minus target loss, so that documents like the target
score above 0.

    p(w)     = (c(w) + 1) / (tokens + words + 1)            one unknown word for the rest
    p(w | v) = (c(v, w) + S p(w)) / (c(v) + S)              c(v): how often v has a word after it

All counts are exact and cover all documents; chances add up to 1. No task or driver holds
a model. Documents are dealt into groups of bounded text by a hash. Each group counts its
own words and pairs of words and sends each once, as hashes in packed rows, to the partition
of its hash, which adds the groups' counts up and sends the totals back in the same order;
then the group scores its documents. A pair that stands in a third of all documents is thus
one entry a group.

Words are runs of word characters, lower-cased. A text that is null or has no word has no
tokens and null losses and score. Rows that repeat a document count as often as they stand there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosecha.llm.tables import free_name, scratch, small_enough, written
from cosecha.llm.text_kernels import mix, word_hashes, word_spans

#: Strength of the unigram model in the bigram model, in tokens.
SMOOTHING = 50.0
#: UTF-8 bytes of text in a group, and hashes in a partition of counts, on average.
GROUP_BYTES = 4 << 20
PART_KEYS = 1 << 20
#: Bytes of a hash that are sent; its leading bits say to which partition.
KEY_BYTES = 6
#: Rows of target ids that may be sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The word before a document's first; no word has it as its hash but by chance.
START = np.uint64(0x53544152545F5F31)

_SENT = ["part", "kind", "grp", "keys", "counts"]
_BACK = "grp long, kind int, part long, totals binary, words long, target long, background long"


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of ``texts``, in order."""
    lowered = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    whose, values = [], []
    # Texts of about a million characters at a time.
    begin = 0
    while begin < len(lowered):
        low = int(ends[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(ends, low + (1 << 20), side="right")), begin + 1)
        part = codes[low : ends[end - 1]]
        starts, stops, doc = word_spans(part, np.concatenate([[0], ends[begin:end] - low]), _word_characters())
        whose.append(doc + begin)
        values.append(word_hashes(part.view(np.uint8), starts * 4, stops * 4))
        begin = end
    return np.concatenate(whose or [np.empty(0, np.int64)]), np.concatenate(values or [np.empty(0, np.uint64)])


class Tokens:
    """The words of a group's documents, the word before each, and the group's different words and pairs in order of hash."""

    def __init__(self, texts: list[str | None]) -> None:
        self.doc, self.word = token_hashes(texts)
        self.before = np.concatenate([[START], self.word[:-1]]) if len(self.word) else self.word
        first = np.ones(len(self.doc), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        self.before[first] = START
        self.words, place = np.unique(np.concatenate([self.word, self.before]), return_inverse=True)
        self.word_at, self.before_at = place[: len(self.word)], place[len(self.word) :]
        self.pairs, self.pair_at = np.unique(mix(self.before * np.uint64(0x9FB21C651E98DF25) + self.word), return_inverse=True)


def _pressed(counts: np.ndarray) -> bytes:
    """Counts, most of which are small, in little room: their low bytes first, so that the empty high ones vanish."""
    return zlib.compress(np.ascontiguousarray(counts).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpressed(raw: bytes, fields: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(fields, -1)


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """The columns of each run of rows with one ``grp``."""
    now, held = None, None
    for batch in batches:
        groups = batch.column("grp").to_numpy()
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
            if a == b:
                continue
            if groups[a] != now:
                if held is not None:
                    yield now, held
                now, held = int(groups[a]), {c: [] for c in batch.schema.names}
            for c in batch.schema.names:
                held[c].extend(batch.column(c)[a:b].to_pylist())
    if held is not None:
        yield now, held


def _counts(rows: DataFrame, parts: int) -> DataFrame:
    """Packed counts of each group (part, kind 0 for words and 1 for pairs, grp, keys, counts); ``rows``: grp, text, is_target, counted; sorted by grp in each partition."""

    def cut(keys: np.ndarray, counts: np.ndarray, kind: int, group: int) -> pa.RecordBatch:
        part = ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        begins = np.flatnonzero(np.diff(part, prepend=-1) != 0)
        stops = [*begins[1:].tolist(), len(part)]
        short = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
        packed = [[short[a:b].tobytes() for a, b in zip(begins.tolist(), stops, strict=True)], [_pressed(counts[:, a:b]) for a, b in zip(begins.tolist(), stops, strict=True)]]
        same = lambda v, t: pa.array([v] * len(begins), t)
        return pa.record_batch([pa.array(part[begins]), same(kind, pa.int32()), same(group, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=_SENT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, held in _groups(batches):
            tokens = Tokens(held["text"])
            sides = [np.array([bool(t) and bool(c) for t, c in zip(held["is_target"], held["counted"], strict=True)]), np.array(held["counted"], bool)]
            tally = lambda at, size, side: np.bincount(at[side[tokens.doc]], minlength=size).astype(np.int64)
            words = [tally(at, len(tokens.words), s) for at in (tokens.word_at, tokens.before_at) for s in sides]
            if len(tokens.words):
                yield cut(tokens.words, np.stack(words), 0, group)
                yield cut(tokens.pairs, np.stack([tally(tokens.pair_at, len(tokens.pairs), s) for s in sides]), 1, group)

    return rows.mapInArrow(count, "part long, kind int, grp long, keys binary, counts binary")


def _totals(counts: DataFrame) -> DataFrame:
    """For each row of ``counts`` the totals over all groups in the order of its keys; and of each part (grp null) its number of words and of tokens."""

    def close(part: int, kind: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        fields = 4 if kind == 0 else 2
        keys = [_keys(k) for _, k, _ in held]
        tallies = np.concatenate([_unpressed(c, fields) for _, _, c in held], axis=1)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.stack([np.bincount(place, t, len(known)) for t in tallies]).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        for (group, _, _), k, end in zip(held, keys, ends.tolist(), strict=True):
            found = _pressed(totals[:, place[end - len(k) : end]])
            columns = [pa.array([group]), pa.array([kind], pa.int32()), pa.array([part]), pa.array([found], pa.binary()), *(pa.array([None], pa.int64()) for _ in range(3))]
            yield pa.record_batch(columns, names=[f.split()[0] for f in _BACK.split(", ")])
        if kind == 0:
            sums = [int((totals[1] > 0).sum()), int(totals[0].sum()), int(totals[1].sum())]
            columns = [pa.array([None], pa.int64()), pa.array([kind], pa.int32()), pa.array([part]), pa.array([None], pa.binary()), *(pa.array([s]) for s in sums)]
            yield pa.record_batch(columns, names=[f.split()[0] for f in _BACK.split(", ")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, kind, group, keys, counts in zip(*(batch.column(c) for c in _SENT), strict=True):
                if (key := (part.as_py(), kind.as_py())) != now:
                    if held:
                        yield from close(*now, held)
                    now, held = key, []
                held.append((group.as_py(), keys.as_py(), counts.as_py()))
        if held:
            yield from close(*now, held)

    return counts.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(add, _BACK)


def _losses(tokens: Tokens, words: np.ndarray, pairs: np.ndarray, size: tuple[int, int, int], smoothing: float) -> list[np.ndarray]:
    """The loss of every token in bits under the target and the background model. ``words``: totals as word and as context, of each side; ``size``: words, target and background tokens."""
    out = []
    for side in (0, 1):
        scale = size[1] / size[2] if side and size[1] and size[2] else 1.0
        unigram = (words[side][tokens.word_at] * scale + 1) / (size[1 + side] * scale + size[0] + 1)
        given = words[2 + side][tokens.before_at] * scale
        out.append(-np.log2((pairs[side][tokens.pair_at] * scale + smoothing * unigram) / (given + smoothing)))
    return out


def _scored(rows: DataFrame, smoothing: float) -> DataFrame:
    """(_row, n_tokens, target_loss, background_loss) of the wanted of ``rows`` (_row, text, is_target, counted, wanted), under models of the counted ones."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    groups = max(1, -(-size // GROUP_BYTES))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("_row", F.lit(8)), F.lit(groups)))
    # A word and the blank after it have six bytes or so; most pairs of a group stand there once.
    parts = max(1, -(-size // (6 * PART_KEYS)))
    dealt = rows.select("grp", "text", "is_target", "counted").repartition("grp").sortWithinPartitions("grp")
    totals = written(_totals(_counts(dealt, parts)), "totals")
    found = totals.filter("grp is null").agg(F.sum("words"), F.sum("target"), F.sum("background")).first()
    corpus = tuple(int(x or 0) for x in found)

    back = totals.filter("grp is not null").select("grp", "kind", "part", "totals", F.lit(None).cast("long").alias("_row"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("wanted"))
    texts = rows.select("grp", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(None).cast("binary").alias("totals"), "_row", "text", "wanted")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches):
            docs = [k for k, kind in enumerate(held["kind"]) if kind == 2]
            tokens = Tokens([held["text"][k] for k in docs])
            sums = [np.zeros(len(docs))] * 2
            count = np.bincount(tokens.doc, minlength=len(docs))
            if len(tokens.word):
                totals = []
                for kind, fields in ((0, 4), (1, 2)):
                    rows = sorted((held["part"][k], k) for k, x in enumerate(held["kind"]) if x == kind)
                    totals.append(np.concatenate([_unpressed(held["totals"][k], fields) for _, k in rows], axis=1))
                sums = [np.bincount(tokens.doc, loss, len(docs)) for loss in _losses(tokens, *totals, corpus, smoothing)]
            wanted = np.array([held["wanted"][k] for k in docs], bool)
            means = [pa.array((s / np.maximum(count, 1))[wanted], mask=(count == 0)[wanted]) for s in sums]
            names = pa.array([held["_row"][k] for k in docs], pa.int64()).filter(pa.array(wanted))
            yield pa.record_batch([names, pa.array(count[wanted].astype(np.int64)), *means], names=["_row", "n_tokens", "target_loss", "background_loss"])

    both = back.unionByName(texts).repartition("grp").sortWithinPartitions("grp")
    return both.mapInArrow(score, "_row long, n_tokens long, target_loss double, background_loss double")


def with_score(docs: DataFrame, corpus: DataFrame | None = None, is_target: str = "is_target", smoothing: float = SMOOTHING) -> DataFrame:
    """``docs`` with n_tokens, target_loss, background_loss (bits a token) and score; columns of these names are replaced.

    The models are those of ``corpus`` (text, and the flag ``is_target``), by default
    ``docs`` itself, whose flag then stays a column. A null flag is no target; without any
    target token the target model is flat.
    """
    docs = docs.drop("n_tokens", "target_loss", "background_loss", "score")
    columns = docs.columns
    row = F.xxhash64(*[c for c in ("doc_id", "text") if c in columns])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = corpus is None
    rows = docs.select(row.alias("_row"), "text", (flag(is_target) if own else F.lit(False)).alias("is_target"), F.lit(own).alias("counted"), F.lit(True).alias("wanted"))
    if not own:
        rows = rows.unionByName(corpus.select(F.xxhash64("text").alias("_row"), "text", flag(is_target).alias("is_target"), F.lit(True).alias("counted"), F.lit(False).alias("wanted")))
    # Rows that repeat a document have equal scores.
    scores = _scored(rows, smoothing).groupBy("_row").agg(*(F.first(c).alias(c) for c in ("n_tokens", "target_loss", "background_loss")))
    score = F.col("s.background_loss") - F.col("s.target_loss")
    key = free_name("_lm_row", columns)
    joined = docs.withColumn(key, row).alias("d").join(written(scores, "scores").alias("s"), F.col(f"d.`{key}`") == F.col("s._row"), "left")
    return joined.select(*(F.col(f"d.`{c}`") for c in columns), F.coalesce("s.n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "s.target_loss", "s.background_loss", score.alias("score"))


def score_documents(docs: DataFrame, target_ids: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the columns of ``with_score``, but for those named in ``without``; the target is the documents whose doc_id is in ``target_ids`` (doc_id).

    A null doc_id is never a target.
    """
    with scratch(docs.sparkSession) as keep:
        mark = free_name("_target", docs.columns)
        marks = written(target_ids.select(F.col("doc_id").alias(mark)).filter(F.col(mark).isNotNull()).distinct(), "targets")
        side = F.broadcast(marks) if small_enough(marks, BROADCAST_ROWS) else marks
        marked = docs.join(side, F.col("doc_id") == F.col(mark), "left").withColumn(mark, F.col(mark).isNotNull())
        return keep(with_score(marked, is_target=mark).drop(mark, *without), "scored")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, losses and score of every document; the target is the documents labelled of good quality."""
    good = labels.filter("quality = 1").select("doc_id")
    return score_documents(docs.select("doc_id", "text"), good, without=("text",))

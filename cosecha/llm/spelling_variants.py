"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Two such words become equal when one code point is deleted from one or both. The hash of every deletion
follows from a prefix and a suffix polynomial hash, so NumPy computes all deletions of a block of words at
once. The integer keys are dealt by their leading bits and sorted; only words whose key another word has
move on with their strings, and these decide: the rest of the work groups the deletions themselves.

No group can be hot: words are distinct, a deletion at one place is shared by one word for each code
point that a word may hold, and a word is a deletion of at most that many words for each of its places.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.llm.tables import scratch, written
from cosecha.llm.text_kernels import mix

#: Leading bits of a key by which rows are dealt to tasks.
RADIX_BITS = 12
#: Code points of words whose deletions are hashed together, and of a text that is taken apart together.
BLOCK = 1 << 18
#: Words that a task counts before it hands them on.
COUNTED = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``BLOCK`` code points that end where no run goes on."""
    begin = 0
    while begin < len(text):
        other = _OTHER.search(text, min(begin + BLOCK, len(text)))
        end = other.start() if other else len(text)
        yield text[begin:end]
        begin = end


def _small(text: str) -> str:
    """A-Z lower-cased, and no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def misspelt(doc_id: int | None, run: str, modulus: int) -> str:
    """The contract's word for a lower-cased run of a document: some lose a code point by a checksum."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counting(modulus: int | None, least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                doc_id = doc_id.as_py()
                for piece in _pieces(_small(text)) if text else ():
                    for run, n in Counter(_RUN.findall(piece)).items():
                        word = misspelt(doc_id, run, modulus) if modulus else run
                        if len(word) >= least:
                            total[word] += n
                    if len(total) > COUNTED:
                        yield _counts(total)
                        total.clear()
        yield _counts(total)

    return count


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, least_chars: int = 5, least_count: int = 3, modulus: int | None = None) -> DataFrame:
    """(word, n) of the runs of Latin letters in ``docs`` (doc_id, text), each task's counts added up first."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counting(modulus, least_chars), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places and word numbers: of every deletion (place from 0), and of every word itself (place -1).

    The prefix hash before a place, plus the suffix hash after it moved down by one, is the deletion's hash.
    Each key also takes in the length.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(words)), sizes)
    places = np.arange(len(points)) - begins[number]
    powers = np.full(int(sizes.max(initial=0)) + 1, _BASE, np.uint64)
    powers[0] = 1
    terms = mix(points + _BASE) * np.cumprod(powers)[places]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    start, end = sums[begins][number], sums[begins + sizes][number]
    deleted = (sums[:-1] - start) + (end - sums[1:]) * _INVERSE
    whole = sums[begins + sizes] - sums[begins]
    lengths = np.concatenate([sizes[number] - 1, sizes]).astype(np.uint64)
    keys = mix(np.concatenate([deleted, whole]) + mix(lengths + np.uint64(1)))
    return keys, np.concatenate([places, np.full(len(words), -1)]), np.concatenate([number, np.arange(len(words))])


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        words = batch.column(1).to_pylist()
        ends = np.cumsum([len(w) for w in words])
        begin = 0
        while begin < len(words):
            end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK, "right")), begin + 1)
            keys, places, number = deletion_hashes(words[begin:end])
            keys, places, own = keys.view(np.int64), places.astype(np.int32), ids[begin:end][number]
            for k in range(0, len(keys), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BLOCK]) for x in (keys, places, own)], names=["key", "place", "id"])
            begin = end


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key more than one word has."""
    left = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if left is not None:
            rows = [np.concatenate(pair) for pair in zip(left, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        # The last key may go on in the next batch.
        left = [x[last:].copy() for x in rows]
        yield _of_many([x[:last] for x in rows])
    if left is not None:
        yield _of_many(left)


def _of_many(rows: list[np.ndarray]) -> pa.RecordBatch:
    keys, places, ids = rows
    if len(keys):
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.minimum.reduceat(ids, begins) != np.maximum.reduceat(ids, begins)
        chosen = np.repeat(many, np.diff(np.append(begins, len(keys))))
        places, ids = places[chosen], ids[chosen]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32())], names=["id", "place"])


def _ranked(n: Column, word: Column) -> Column:
    """Least for the word that is met most often, the smallest among equals."""
    return F.struct((-n).alias("less"), word.alias("word"))


def deletion_keys(words: DataFrame) -> DataFrame:
    """(key, place, id): the hash of every deletion of ``words`` (id, word) by place, and of each word (place -1)."""
    return words.select("id", "word").mapInArrow(_deletions, "key long, place int, id long")


def near_words(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(word, n_near, best) for the words of ``words`` (id, word, n; written) that have a near word.

    Equal deletions have equal ``keys``; what else shares a key is told apart by its strings. best is a struct
    (less, word): minus the count of the near word met most often, and that word.
    """
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    shared = dealt.mapInArrow(_shared, "id long, place int")
    place = F.col("place")
    stem = F.when(place < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word"))))
    # A place inside a run of equal letters gives the same word as the run's first.
    first_of_run = (place == 0) | (F.substring("word", place + 1, F.lit(1)) != F.substring("word", place, F.lit(1)))
    rows = shared.distinct().join(words, "id").select(stem.alias("stem"), "place", "word", _ranked(F.col("n"), F.col("word")).alias("rank"), first_of_run.alias("first"))
    rows = written(rows, "deletions")

    same = Window.partitionBy("stem", "place")
    order = same.orderBy("rank")
    others = rows.filter("place >= 0").select(
        "word", "rank", F.count(F.lit(1)).over(same).alias("size"), F.row_number().over(order).alias("nth"), F.min("rank").over(same).alias("least"), F.lead("rank").over(order).alias("next")
    )
    best = F.when(F.col("nth") == 1, F.col("next")).otherwise(F.col("least"))
    replaced = others.filter("size > 1").select("word", (F.col("size") - 1).alias("n_near"), best.alias("best"))

    mark = rows.filter("place < 0 or first").withColumn("whole", F.when(F.col("place") < 0, F.col("rank")))
    stems = mark.groupBy("stem").agg(F.max("whole").alias("whole"), F.count(F.when(F.col("place") >= 0, 1)).alias("longer"), F.min(F.when(F.col("place") >= 0, F.col("rank"))).alias("best"))
    stems = written(stems.filter("whole is not null and longer > 0"), "stems")
    shorter = stems.select("whole.word", F.col("longer").alias("n_near"), "best")
    longer = mark.filter("place >= 0").join(stems.select("stem", F.col("whole").alias("best")), "stem").select("word", F.lit(1).cast("long").alias("n_near"), "best")
    return replaced.unionByName(shorter).unionByName(longer).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from ``forms`` (word, form; written): the last form, in rounds that double the steps taken."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = written(further, "roots")
        steps = further.drop("moved")
        if further.filter("moved").isEmpty():
            return steps


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct ``words`` (word, n).

    A word's form is its near word met most often (ties: the smallest), if that is met at least ``factor`` (over 1)
    times as often; its root is the last word along the forms, itself without one. Words that have no near word stay.
    """
    with scratch(words.sparkSession) as keep:
        words = written(words.withColumn("id", F.monotonically_increasing_id()), "words")
        found = words.join(near_words(words, deletion_keys(words)), "word", "left")
        formed = -F.col("best.less") >= factor * F.col("n")
        found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(formed, c).alias(a) for a, c in (("form", F.col("best.word")), ("form_n", -F.col("best.less")))]), "near")
        roots = _roots(found.filter("form is not null").select("word", "form"))
        out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return keep(out, "variants")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns over all ``docs`` (doc_id, text): null texts have no words, a null doc_id is written as nothing."""
    return spelling_variants(word_counts(docs, modulus=97))

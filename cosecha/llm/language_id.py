"""Language identification by rank-order profiles.

A profile is a ranking of the most frequent character n-grams (1 to 3 letters of
lower-cased words, with a blank at each end of a word). A language's profile comes from
the counts over all its labelled documents; a document is given the language whose
profile is the least out of place with its own: the sum, over the document's n-grams, of
the differences of rank, or the profile's length where the language lacks the n-gram.

The score is 1 minus that distance over the largest possible one. Ties go to the
language that sorts first. A text that is null or has no letter is ``und`` with score 0,
and so is every text if nothing was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cosecha.llm.text_kernels import giving_back

from cosecha.llm.tables import free_name

UNKNOWN = "und"
#: Ranks of a profile.
PROFILE = 400
#: Distinct n-grams of one language that a task holds before it passes their counts on.
HELD = 500_000
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else 0 (a blank)."""
    codes = np.arange(0x110000, dtype=np.int64)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, codes, 0)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of ``text`` as longs, sorted, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.zeros(len(points) + 2, np.int64)
    line[1:-1] = _letters()[points]
    one = line[1:-1][line[1:-1] > 0]
    a, b = line[:-1], line[1:]
    two = ((a << _BITS) | b)[(a > 0) | (b > 0)]
    a, b, c = line[:-2], line[1:-1], line[2:]
    three = ((a << 2 * _BITS) | (b << _BITS) | c)[b > 0]
    # Two letters after a blank are the same long as the two letters alone; negative longs keep the pairs apart.
    return np.unique(np.concatenate([one, ~two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, the smaller one first on ties."""
    return grams[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """(lang, gram, place from 0) of every language among ``docs`` (text, lang); null languages and texts teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge() -> None:
            for lang, parts in waiting.items():
                parts = parts + [held[lang]] if lang in held else parts
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                held[lang] = grams, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
            waiting.clear()

        def rows(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                grams, counts = held.pop(lang)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                grams = gram_counts(text.as_py())
                waiting.setdefault(lang, []).append(grams)
                size += len(grams[0])
                if size > HELD:
                    merge()
                    size = 0
                    yield from rows([x for x, (g, _) in held.items() if len(g) > HELD])
        merge()
        yield from rows(list(held))

    labelled = docs.select("text", "lang").filter("text is not null and lang is not null")
    counts = labelled.mapInArrow(giving_back(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First each slice's best, then the best of those: no task ranks a whole language.
    for by in (["lang", "slice"], ["lang"]):
        counts = counts.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(64))) if "slice" in by else counts
        counts = counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram")) - 1).filter(F.col("place") < most)
    return counts.select("lang", "gram", "place")


class RankModel:
    """Profiles of some languages side by side."""

    def __init__(self, profiles: pd.DataFrame, most: int = PROFILE) -> None:
        """``profiles``: lang, gram, place; at most ``most`` rows of each language."""
        self.most = most
        self.langs = sorted(profiles["lang"].unique())
        self.grams = np.unique(profiles["gram"].to_numpy(np.int64))
        # A last column stands for n-grams that no profile has.
        self.places = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        number = {lang: k for k, lang in enumerate(self.langs)}
        row = profiles["lang"].map(number).to_numpy(int)
        self.places[row, np.searchsorted(self.grams, profiles["gram"].to_numpy(np.int64))] = profiles["place"].to_numpy(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        grams, counts = gram_counts(text)
        if not len(grams):
            return UNKNOWN, 0.0
        own = ranked(grams, counts, self.most)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        theirs = self.places[:, at]
        distance = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(own)))).sum(1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.most * len(own)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_language(docs: DataFrame, model: RankModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced, rows stay as they are."""
    docs = docs.drop("lang_pred", "score")
    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.predict(t.as_py()) for t in batch.column(text)]
            new = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(giving_back(predict), schema)


def learned(docs: DataFrame, most: int = PROFILE) -> RankModel:
    """The model of all labelled documents that are not held out; the driver gets ``most`` rows of each language."""
    return RankModel(learn_profiles(docs.filter(~held_out(F.col("doc_id"))), most).toPandas(), most)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row."""
    narrow = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return with_language(narrow, learned(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without documents that no language can be given: no letter, or no n-gram of any profile."""
    columns = docs.columns
    lang, score = (free_name(n, columns) for n in ("_lang_pred", "_score"))
    spared = docs.withColumnsRenamed({"lang_pred": lang, "score": score})
    marked = with_language(spared, learned(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    return marked.drop("lang_pred", "score").withColumnsRenamed({lang: "lang_pred", score: "score"}).select(*columns)

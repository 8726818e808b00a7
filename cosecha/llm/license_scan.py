"""Search for short license notices with a bounded number of edits.

A notice with at most e edits, cut into e + 1 pieces, has one piece unharmed (pigeonhole), so the exact
pieces, looked up all at once, lead to every place where it can stand. Only these places are verified, by the
``regex`` library's bounded-error matching, which also gives the span and the edits. A text is reduced to its
words first, A-Z lower-cased and one blank between them, so breaks and signs never count as edits.

It is a projection over whole texts: no row moves, and a worker holds one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from cosecha.llm.tables import free_name


class Notice(NamedTuple):
    """A notice's words, its label, and whether its exact places count as base ones."""

    words: str
    label: str
    base: bool = False


# The base phrases and their labels, then short notices of the licenses' own texts.
NOTICES = (
    Notice("mit license", "mit", True),
    Notice("apache license", "apache", True),
    Notice("general public license", "gpl", True),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("licensed under the apache license version 2 0", "apache"),
    Notice("gnu general public license as published by the free software foundation", "gpl"),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd"),
    Notice("mozilla public license", "mpl"),
    Notice("creative commons attribution", "cc"),
    Notice("licensed under cc by nc 4 0", "cc"),
)

#: Code points of a notice for each edit that it may have; the shortest may have one.
CHARS_PER_EDIT = 11

_SPAN = StructType().add("label", "string").add("notice", "string").add("first_word", "long").add("last_word", "long").add("edits", "integer").add("base", "boolean")
_SCAN = StructType().add("n_words", "long").add("spans", ArrayType(_SPAN))
_ARROW = to_arrow_schema(StructType([StructField("scan", _SCAN)])).field("scan").type

#: Bytes of words as they are, capitals as small letters, all others as blanks; every byte of a code point beyond ASCII is a word's.
_WORDS = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces_of(notice: str) -> list[tuple[int, str]]:
    """The notice in one piece more than it may have edits: (offset, piece)."""
    parts = edits_of(notice) + 1
    cuts = [len(notice) * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def as_words(text: str) -> bytes:
    """The words of a text with one blank before, between and after them."""
    return re.sub(rb" {2,}", b" ", b" " + text.encode("utf-8", "surrogatepass").translate(_WORDS) + b" ")


def bounded_error_pattern(notice: str) -> regex.Pattern:
    """Whole words that become the notice by so few edits as it may have; the best fit at a place."""
    return regex.compile(rf"(?e)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits_of(notice)}}}(?= )")


@lru_cache(maxsize=8)
def _tools(notices: tuple[Notice, ...]) -> tuple[ahocorasick.Automaton, list]:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, notice in enumerate(notices):
        for offset, piece in pieces_of(notice.words):
            seeds.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, found in seeds.items():
        automaton.add_word(piece, (len(piece), found))
    automaton.make_automaton()
    exact = [re.compile(rf"(?<= ){re.escape(n.words)}(?= )") for n in notices]
    return automaton, [(n, e, bounded_error_pattern(n.words)) for n, e in zip(notices, exact)]


def _windows(words: bytes, automaton: ahocorasick.Automaton, notices: Sequence) -> dict[int, list[list[int]]]:
    """By notice, the disjoint stretches in which it can stand, with a blank to look at on both sides."""
    windows: dict[int, list[list[int]]] = {}
    for last, (size, found) in automaton.iter(words.decode("latin-1")):
        for k, offset in found:
            notice = notices[k][0].words
            # Every edit moves an end by at most one code point, which has at most four bytes.
            slack = 4 * edits_of(notice) + 2
            start = last + 1 - size - offset
            begin, end = max(start - slack, 0), min(start + len(notice) + slack, len(words))
            while begin > 0 and words[begin] & 0xC0 == 0x80:
                begin -= 1
            while end < len(words) and words[end] & 0xC0 == 0x80:
                end += 1
            own = windows.setdefault(k, [])
            # A notice's pieces come in order of their ends, so a window may begin before the last one.
            while own and own[-1][1] >= begin:
                before = own.pop()
                begin, end = min(begin, before[0]), max(end, before[1])
            own.append([begin, end])
    return windows


def find_notices(text: str | None, notices: tuple[Notice, ...] = NOTICES) -> dict:
    """Number of words, and the spans of notices in words from 0, in order; a null text is empty."""
    if not text:
        return {"n_words": 0, "spans": []}
    automaton, tools = _tools(notices)
    words = as_words(text)
    found = []
    for which, own in _windows(words, automaton, tools).items():
        notice, exact, fuzzy = tools[which]
        for begin, end in own:
            part = words[begin:end].decode("utf-8", "surrogatepass")
            whole = [m.span() for m in exact.finditer(part)]
            spans, k = [(a, b, 0) for a, b in whole], 0
            for m in fuzzy.finditer(part):
                while k < len(whole) and whole[k][1] <= m.start():
                    k += 1
                if k == len(whole) or whole[k][0] >= m.end():
                    spans.append((*m.span(), sum(m.fuzzy_counts)))
            at, size = 0, begin
            for a, b, edits in sorted(spans):
                size, at = size + len(part[at:a].encode("utf-8", "surrogatepass")), a
                found.append((size, size + len(part[a:b].encode("utf-8", "surrogatepass")), notice, edits))
    spans, at, count = [], 0, -1
    for begin, end, notice, edits in sorted(found, key=lambda f: (f[0], f[1], f[2].words)):
        count, at = count + words.count(b" ", at, begin), begin
        spans.append({"label": notice.label, "notice": notice.words, "first_word": count, "last_word": count + words.count(b" ", begin, end), "edits": edits, "base": notice.base and edits == 0})
    return {"n_words": words.count(b" ") - 1, "spans": spans}


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, text: str = "text", name: str = "license_scan") -> DataFrame:
    """``docs`` with a struct (n_words, spans) of the notices in ``text``.

    A span has label, notice, first_word, last_word (from 0), edits and whether it is a base place. The new
    column has underscores before ``name`` where the table has that name already. Null and empty texts have no
    words and no spans; rows may repeat and every text is read whole.
    """
    notices, out = tuple(notices), free_name(name, docs.columns)
    place = docs.columns.index(text)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time leaves Arrow.
            rows = pa.array((find_notices(value.as_py(), notices) for value in batch.column(place)), _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, out])

    return docs.mapInArrow(scanned, StructType([*docs.schema.fields, StructField(out, _SCAN)]))


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; score is the best likeness of a span, 1 - edits / code points of its notice."""
    rows = scan(docs.select("doc_id", "text"), name="found").drop("text")
    spans = F.col("found.spans")
    base = F.filter(spans, lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    likeness = F.transform(spans, lambda s: 1 - s["edits"] / F.char_length(s["notice"]))
    return rows.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(spans).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
        F.size(spans).cast("long").alias("n_spans"),
    )

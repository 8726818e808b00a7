"""Removal of long repeated passages by longest-previous-factor arrays.

A passage is any string of ``length`` bytes (400) that starts at two places of the
corpus. Suffix arrays of a whole corpus do not distribute, so the corpus is first cut
into independent cells without losing a match:

1. *Anchors.* Every window of ``length`` bytes picks the smallest hash of its 100-byte
   grams (leftmost on ties). Equal windows pick the same gram at the same offset, so
   they meet in the cell of that gram. The windows of one document that share an anchor
   are consecutive and form one *context*. Only hashes are shuffled here.
2. *Equal contexts* of a cell are counted, not gathered: windows of a context that
   occurs twice all repeat. Most matches end here, whatever the number of copies.
3. *Cells with several different contexts* get one text each per context, in order of
   first occurrence, and a suffix array by prefix doubling, truncated at ``length``
   bytes. Common prefixes of neighbours come from the ranks of the doubling; the previous
   and next smaller positions in suffix order then give each window's longest previous
   factor (up to ``length``) and where it stands. Windows whose factor reaches ``length``
   repeat an earlier one; all comparisons are of bytes.
4. *Hot cells* (over ``hot_cell`` different contexts, such as the edges of a passage
   that very many documents share) are first halved again and again: a half whose
   common core occurs once has no match, a half that occurs twice whole is a match,
   and only halves between the two go on, down to single windows. All of it is counts
   by key, so no task ever holds such a cell.

Matches never cross documents. Documents shorter than ``length`` keep everything; null
texts count as empty. Rows that repeat id and text are separate documents; a null id is
an id like any other. Extra columns pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosecha.llm.tables import free_name, scratch, written
from cosecha.llm.text_kernels import CHUNK_BYTES, SpanHasher, giving_back, text_bytes

GRAM = 100
HOT_CELL = 256
_POSITION = np.uint64((1 << 24) - 1)


def _pieces(offsets: np.ndarray, length: int, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, begin, end): about ``most`` bytes each; long documents come in pieces that share length - 1 bytes."""
    group, held = [], 0
    for doc in range(len(offsets) - 1):
        begin, stop = int(offsets[doc]), int(offsets[doc + 1])
        while stop - begin >= length:
            end = min(stop, begin + most)
            if held and held + end - begin > most:
                yield group
                group, held = [], 0
            group.append((doc, begin, end))
            held += end - begin
            if end == stop:
                break
            begin = end - length + 1
    if group:
        yield group


def _piece_anchors(data: np.ndarray, cuts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For pieces that lie one after another in ``data``: gram hash, context hash, piece, anchor, first and last window start."""
    hashes, others = SpanHasher(data), SpanHasher(data[::-1])
    grams = hashes.every(gram)
    width = length - gram + 1
    keys = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(grams)] = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    rows = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    smallest = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _POSITION
    inside = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    anchor = smallest[inside].astype(np.int64)
    piece = np.searchsorted(cuts, inside, side="right") - 1
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(new)
    low, high = inside[at], inside[np.append(at[1:], len(inside)) - 1]
    # Contexts count as equal by their hashes from both ends.
    both = hashes(low, high + length) ^ (others(len(data) - high - length, len(data) - low) * np.uint64(0x9FB21C651E98DF25))
    return grams[anchor[at]], both, piece[at], anchor[at], low, high


def contexts(docs: DataFrame, length: int = 400, gram: int = GRAM) -> DataFrame:
    """One row per document and anchor: cell, context (hashes), _row_key, doc_id, first and last window start, and the anchor's lead over the first."""
    schema = "cell long, context long, _row_key long, doc_id long, low long, high long, lead int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for group in _pieces(offsets, length, CHUNK_BYTES):
                part = np.concatenate([data[a:b] for _, a, b in group])
                cuts = np.cumsum([0, *(b - a for _, a, b in group)])
                cell, context, piece, anchor, low, high = _piece_anchors(part, cuts, length, gram)
                doc = np.array([g[0] for g in group])[piece]
                shift = (np.array([g[1] for g in group]) - cuts[:-1])[piece] - offsets[doc]
                which = pa.array(doc)
                columns = [pa.array(cell.view(np.int64)), pa.array(context.view(np.int64)), batch.column("_row_key").take(which), batch.column("doc_id").take(which)]
                columns += [pa.array(low + shift), pa.array(high + shift), pa.array((anchor - low).astype(np.int32))]
                yield pa.record_batch(columns, names=["cell", "context", "_row_key", "doc_id", "low", "high", "lead"])

    return docs.select("_row_key", "doc_id", "text").mapInArrow(giving_back(cut), schema)


def suffix_levels(data: np.ndarray, ends: np.ndarray, cells: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(reach, rank): ranks of all suffixes by (cell, first ``reach`` bytes), by prefix doubling up to ``depth``; ``ends`` holds each position's end of context."""
    count = len(data)
    at = np.arange(count)
    symbols = data.astype(np.int64) + 1
    key, reach = cells.astype(np.int64), min(6, depth)
    for k in range(reach):
        ahead = np.where(at + k < ends, symbols[np.minimum(at + k, count - 1)], 0)
        key = key * 257 + ahead
    rank = np.unique(key, return_inverse=True)[1]
    levels = [(reach, rank.astype(np.int32))]
    while reach < depth:
        step = min(reach, depth - reach)
        follow = np.where(at + step < ends, rank[np.minimum(at + step, count - 1)] + 1, 0)
        rank = np.unique(rank * (count + 1) + follow, return_inverse=True)[1]
        reach += step
        levels.append((reach, rank.astype(np.int32)))
    return levels


def common_prefixes(a: np.ndarray, b: np.ndarray, data: np.ndarray, ends: np.ndarray, cells: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, up to the depth of ``levels``; 0 across cells."""
    depth, last = levels[-1][0], len(data) - 1
    found = np.where(levels[-1][1][a] == levels[-1][1][b], depth, 0)
    for reach, rank in reversed(levels[:-1]):
        x, y = a + found, b + found
        inside = (found + reach <= depth) & (x < ends[a]) & (y < ends[b])
        found += np.where(inside & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)]), reach, 0)
    open_ = found < depth
    for _ in range(min(6, depth)):
        x, y = np.minimum(a + found, last), np.minimum(b + found, last)
        open_ &= (found < depth) & (a + found < ends[a]) & (b + found < ends[b]) & (data[x] == data[y])
        found += open_
    found = np.minimum(found, np.minimum(ends[a] - a, ends[b] - b))
    return np.where(cells[a] == cells[b], found, 0)


def longest_previous_factors(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in suffix order: the length of the longest earlier match, and the index of one (-1 for none).

    ``places`` are their text positions and ``common`` the common prefixes of neighbours.
    The longest match at an earlier position is with the nearest suffix of smaller position
    on one of the two sides in suffix order. All suffixes look for theirs at once: one
    that finds a larger position goes on from where that one has come to, so the steps double.
    """
    count = len(places)
    best, source = np.zeros(count, np.int64), np.full(count, -1)
    for side in (-1, 1):
        to = np.arange(count) + side
        least = np.concatenate([[0], common]) if side < 0 else np.concatenate([common, [0]])
        live = np.flatnonzero(least > 0)
        while True:
            live = live[least[live] > 0]
            live = live[places[to[live]] > places[live]]
            if not len(live):
                break
            over = to[live]
            further, shorter = to[over], np.minimum(least[live], least[over])
            to[live], least[live] = further, shorter
        longer = least > best
        best[longer], source[longer] = least[longer], to[longer]
    return best, source


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _solve_cells(cells: list[tuple[int, list[tuple[int, bytes]]]], length: int, first_stays: bool) -> pa.RecordBatch:
    """Covered byte ranges of each context; a cell's contexts come in the order of their first occurrence."""
    texts = [(cell, context, text) for cell, members in cells for context, text in members]
    number = {cell: k for k, (cell, _) in enumerate(cells)}
    sizes = np.array([len(t) for _, _, t in texts])
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)
    owner = np.repeat(np.array([number[c] for c, _, _ in texts]), sizes)
    ends = np.repeat(stops, sizes)
    levels = suffix_levels(data, ends, owner, length)
    full = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(sizes, stops, strict=True)])
    places = full[np.lexsort((full, levels[-1][1][full]))]
    factor, source = longest_previous_factors(places, common_prefixes(places[:-1], places[1:], data, ends, owner, levels))
    repeats = factor >= length
    chosen = places[repeats]
    if not first_stays:
        # What others repeat goes as well: each chain of sources ends at the first of its kind.
        chosen = np.union1d(chosen, places[source[repeats]])
    hit = np.zeros(len(data) + 1, np.int64)
    np.add.at(hit, chosen, 1)
    np.add.at(hit, chosen + length, -1)
    covered = np.cumsum(hit)[:-1] > 0
    out: list[tuple[int, int, int, int]] = []
    for (cell, context, _), size, stop in zip(texts, sizes, stops, strict=True):
        for a, b in zip(*_runs(covered[stop - size : stop]), strict=True):
            out.append((cell, context, int(a), int(b)))
    return pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["cell", "context", "begin", "end"])


def _cell_ranges(members: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """Covered ranges within the contexts of small cells. ``members``: cell, context, first (order), bytes."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[tuple[int, bytes]]]] = []
        size = 0
        for batch in batches:
            for cell, context, text in zip(batch.column("cell").to_pylist(), batch.column("context").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if not held or held[-1][0] != cell:
                    if size > CHUNK_BYTES:
                        yield _solve_cells(held, length, first_stays)
                        held, size = [], 0
                    held.append((cell, []))
                held[-1][1].append((context, text))
                size += len(text)
        if held:
            yield _solve_cells(held, length, first_stays)

    dealt = members.repartition("cell").sortWithinPartitions("cell", "first", "context")
    return dealt.select("cell", "context", "bytes").mapInArrow(giving_back(solve), "cell long, context long, begin long, end long")


def _split_ranges(members: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """As ``_cell_ranges`` for hot cells, by splitting their windows on a grid of offsets from the anchor.

    The windows of a block share a core; if no other context has that core there, none of
    them repeats. If another context has the whole block, all of them do. What is left is
    split on, down to single windows. ``members`` also has ``anchor_at``, the anchor's
    place in the context.
    """
    lowest, highest = -F.col("anchor_at"), F.length("bytes") - length - F.col("anchor_at")
    live = members.withColumn("parent", F.lit(None).cast("long"))
    found = None
    grids = (64, 8, 1)
    for above, grid in zip((None, *grids), grids, strict=False):
        first_block = F.floor(lowest / grid) if above is None else F.greatest(F.floor(lowest / grid), F.col("parent") * (above // grid))
        last_block = F.floor(highest / grid) if above is None else F.least(F.floor(highest / grid), (F.col("parent") + 1) * (above // grid) - 1)
        blocks = live.withColumn("block", F.explode(F.sequence(first_block.cast("long"), last_block.cast("long"))))
        inside = (F.col("block") * grid >= lowest) & ((F.col("block") + 1) * grid - 1 <= highest)
        core = F.expr(f"xxhash64(substring(bytes, int((block + 1) * {grid} + anchor_at), {length - grid + 1}))")
        whole = F.when(inside, F.expr(f"xxhash64(substring(bytes, int(block * {grid} + anchor_at + 1), {length + grid - 1}), 1)"))
        blocks = written(blocks.withColumns({"core": core, "whole": whole}), "blocks")
        counts = {}
        for kind in ("core", "whole"):
            tally = blocks.filter(F.col(kind).isNotNull()).groupBy("cell", "block", kind).agg(F.count(F.lit(1)).alias("alike"), F.min("first").alias("leader"))
            counts[kind] = written(tally.filter("alike > 1").select("cell", "block", kind, F.col("leader").alias(f"{kind}_leader")), kind)
        # Counts are tables of their own, so that joins on a hot key can be split.
        shared = blocks.join(counts["core"], ["cell", "block", "core"]).join(counts["whole"], ["cell", "block", "whole"], "left")
        alike = F.col("whole_leader").isNotNull()
        leads = alike & (F.col("first") == F.col("whole_leader"))
        match = alike & ~leads if first_stays else alike
        begin = F.col("block") * grid + F.col("anchor_at")
        hits = shared.filter(match).select("cell", "context", begin.alias("begin"), (begin + grid - 1 + length).alias("end"))
        hits = written(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
        if grid > 1:
            # The leader of a matched block goes on for all its kind: parts of it may match others.
            left = shared.filter(~alike | leads).select(*members.columns, F.col("block").alias("parent"))
            live = written(left, "split")
            if live.isEmpty():
                break
    return found


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_key``, which decides id and text; rows that repeat both have one key and one result."""
    return docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))


def repeated_ranges(docs: DataFrame, length: int = 400, first_stays: bool = True, gram: int = GRAM, hot_cell: int = HOT_CELL) -> DataFrame:
    """Byte ranges (_row_key, begin, end) to remove from ``docs`` (_row_key, doc_id, text); they may overlap.

    ``first_stays``: a passage's first occurrence (by doc_id, then place) is kept;
    otherwise every occurrence goes.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_ranges_of(docs, length, first_stays, gram, hot_cell), "repeated-ranges")


def _ranges_of(docs: DataFrame, length: int, first_stays: bool, gram: int, hot_cell: int) -> DataFrame:
    places = written(contexts(docs, length, gram), "contexts")
    place = F.struct("doc_id", "_row_key", "low", "high", "lead")
    kinds = written(places.groupBy("cell", "context").agg(F.count(F.lit(1)).alias("alike"), F.min(place).alias("first")), "kinds")
    cells = kinds.groupBy("cell").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    cells = written(cells, "cells")

    later = places.join(kinds.filter("alike > 1").select("cell", "context", "first"), ["cell", "context"])
    if first_stays:
        later = later.filter(place != F.col("first"))
    copies = later.select("_row_key", F.col("low").alias("begin"), (F.col("high") + length).alias("end"))

    # The bytes of each different context, once, from its first occurrence.
    mixed = kinds.join(cells, "cell").select("cell", "context", "alike", "kinds", "first", "first._row_key", "first.low", "first.high", F.col("first.lead").alias("anchor_at"))
    mixed = written(mixed, "mixed")
    cut = F.expr(f"substring(cast(text as binary), int(low + 1), int(high - low + {length}))")
    members = docs.select("_row_key", "text").join(mixed, "_row_key").select("cell", "context", "kinds", "first", "anchor_at", cut.alias("bytes"))
    # Rows that repeat id and text bring the same context again.
    members = written(members, "members").groupBy("cell", "context").agg(*(F.first(c).alias(c) for c in ("kinds", "first", "anchor_at", "bytes")))
    members = members if mixed.isEmpty() else written(members, "once")
    ranges = _cell_ranges(members.filter(F.col("kinds") <= hot_cell), length, first_stays)
    hot = members.filter(F.col("kinds") > hot_cell).drop("kinds")
    if not hot.isEmpty():
        ranges = ranges.unionByName(_split_ranges(hot, length, first_stays))
    ranges = written(ranges, "ranges")
    single = mixed if first_stays else mixed.filter("alike = 1")
    edges = ranges.join(single.select("cell", "context", "_row_key", "low"), ["cell", "context"])
    edges = edges.select("_row_key", (F.col("low") + F.col("begin")).alias("begin"), (F.col("low") + F.col("end")).alias("end"))
    return copies.unionByName(edges)


def _without(text: bytes, ranges: list[dict[str, int]] | None, whole_characters: bool) -> tuple[bytes, int]:
    """``text`` without the union of ``ranges``, and the number of maximal runs removed."""
    runs: list[list[int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges or ()):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    kept, at = [], 0
    for begin, end in runs:
        if whole_characters:
            # Characters that are only partly covered stay.
            while begin < end and text[begin] & 0xC0 == 0x80:
                begin += 1
            while begin < end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
        kept.append(text[at:begin])
        at = end
    kept.append(text[at:])
    return b"".join(kept), len(runs)


def remove_repeats(docs: DataFrame, length: int = 400, first_stays: bool = True, gram: int = GRAM, hot_cell: int = HOT_CELL, whole_characters: bool = False) -> DataFrame:
    """``docs`` with kept_bytes, n_bytes, n_removed and n_spans (maximal removed runs); columns of these names are replaced.

    ``whole_characters``: a character that a removed run covers in part is kept, so that kept_bytes is valid UTF-8.
    """
    added = ["kept_bytes", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*added)
    # Columns that are named like those made here get their names back at the end.
    own = {c: free_name(f"_own{c}", docs.columns) for c in docs.columns if c in ("_row_key", "_ranges")}
    keyed = with_row_key(docs.withColumnsRenamed(own))
    ranges = repeated_ranges(keyed.select("_row_key", "doc_id", "text"), length, first_stays, gram, hot_cell)
    per_doc = ranges.groupBy("_row_key").agg(F.collect_set(F.struct("begin", "end")).alias("_ranges"))
    joined = keyed.join(per_doc, "_row_key", "left").drop("_row_key")
    plain = [c for c in joined.columns if c != "_ranges"]
    schema = joined.drop("_ranges").schema.add("kept_bytes", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                rest, runs = _without(raw, cuts, whole_characters)
                kept.append(rest)
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(runs)
            new = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *new], names=[*plain, *added])

    return joined.mapInArrow(giving_back(apply), schema).withColumnsRenamed({new: old for old, new in own.items()})


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: every copy of a repeated 400-byte string goes, the first too."""
    done = remove_repeats(docs.select("doc_id", "text"), first_stays=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))

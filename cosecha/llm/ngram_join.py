"""Exact Jaccard self-join of word n-gram sets, by signature trees inside exact cells.

A text's set: its distinct runs of ``words`` words (maximal runs of bytes other than
space and 0x09-0x0D, A-Z lower-cased); a text with fewer words has its whole word
sequence as its one element; a text without words (null, empty) has the empty set and
links with nothing. Elements are 64-bit hashes of words, eight bytes at a time.

Two sets link when ``percent`` * |union| <= 100 * |intersection|. The steps:

1. *Equal sets* become one node, whatever their number, before anything else is sent.
   A second, independent hash confirms them; two sets that share the first one stop the job.
2. *Cells.* Sizes fall into classes; linked sets of a class differ in at most H
   elements. Elements fall by hash into H + 1 + slack buckets, so linked sets have at
   least 1 + slack buckets alike; a set with at most slack empty buckets need not emit
   those. A cell is one bucket's content. No element frequency matters, and a passage
   that many texts share makes few common cells, as whole buckets must be alike. Cells
   travel packed, ten bytes each. Of a cell that several sets of one task have, only two go
   to the cell's partition, where cells of several sets are found; the others are known to
   belong to such a cell and are dealt out elsewhere, so a hot cell fills no task.
3. *Pruning.* A set stays only while 1 + slack of its cells have other sets; after the
   first round below, sets of other components.
4. *Signature trees.* A cell's members form a tree whose nodes hold OR-combined bitmaps
   of hashed elements and size ranges; a dual traversal drops node pairs whose largest
   possible overlap is too small, and compares what is left exactly. Members that are
   already connected are not compared again, so a group of copies costs about its size.
5. *Rounds.* First every set meets the members of its most popular cell, in blocks of
   bounded size around a common hub. The sets of cells that then still hold several
   components meet again by their rarest elements (below), where only the bitmaps meet: a
   set that some other component's bitmap does not rule out is a candidate of that pair of
   components, or of the group where many components meet. Last, the candidates of each
   pair of components, or group, are compared. All three run in blocks of bounded elements.
   Together they find every link that the components need; pairs of sets are never listed.
6. *Rare elements.* Linked sets of a and b elements share percent / (100 + percent) of
   a + b. Under one order of all elements, rare ones first, their first common element is
   then so early in both that only the elements up to there need be met by; the larger
   the other set, the fewer, so sizes fall into bands and each pair of bands has
   groups of its own. What no other set has takes up these places, so near copies that
   are too far apart meet nowhere, however many they are. The order comes from counters of
   a fixed number; elements that share one are only ordered less well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosecha.llm.components import connected
from cosecha.llm.tables import scratch, small_enough, written
from cosecha.llm.text_kernels import chunks, giving_back, mix, text_bytes, word_hashes, word_spans

#: Sets of a cell that one task compares at a time; a set of more than WEIGHT elements counts as several.
BLOCK = 256
WEIGHT = 2048
#: Rows of a few longs that may be sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Cells that a task holds before it sends them on, and that one partition of cells has on average.
CELLS = 500_000
_FAN_OUT = 4
#: Candidate rows per set from which a unit's candidates are compared in the unit, not by pairs of components.
_DENSE = 3
#: Elements that a task gathers before it passes their sets on.
_ELEMENTS = 1 << 18
#: Links or candidates that a task holds before it passes them on, a unit's at least.
_FOUND = 1 << 14

#: Counters that order elements by rarity, a fixed number, as every task gets them; a slice of them is added up at a time.
COUNTERS = 1 << 20
_SLICE = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ONE = np.uint64(1)


def _seed(k: int) -> np.uint64:
    return mix(np.array([k * 0x9E3779B97F4A7C15 + 0x1234567 & (1 << 64) - 1], np.uint64))[0] | np.uint64(1)


def element_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct element, sorted by document, then hash."""
    data = _LOWER[data]
    starts, ends, doc = word_spans(data, offsets, _IN_WORD)
    if len(starts) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    each = word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    seeds = [_seed(k) for k in range(words + 1)]
    where, values = [], []
    if len(each) >= words:
        full = np.flatnonzero(doc[: len(doc) - words + 1] == doc[words - 1 :])
        total = np.zeros(len(full), np.uint64)
        for k in range(words):
            total += each[full + k] * seeds[k]
        where.append(doc[full])
        values.append(mix(total))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.searchsorted(doc, short)
        total = np.full(len(short), seeds[words], np.uint64)
        for k in range(words - 1):
            has = count[short] > k
            total += np.where(has, each[np.minimum(first + k, len(each) - 1)] * seeds[k], np.uint64(0))
        where.append(short)
        values.append(mix(total + count[short].astype(np.uint64)))
    doc, value = np.concatenate(where), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


class Classes:
    """Size classes [low, high) with their numbers of buckets, for a threshold in percent."""

    def __init__(self, percent: int) -> None:
        lows, low = [], 1
        while low < 1 << 40:
            lows.append(low)
            low = max(low + 1, low * 3 // 2)
        self.percent = percent
        self.lows = np.array(lows, np.int64)
        largest = np.append(self.lows[1:], low) - 1
        partner = largest * 100 // percent
        # Linked sets of sizes a and b differ in at most (100 - percent) / (100 + percent) * (a + b) elements.
        self.differ = (100 - percent) * (largest + partner) // (100 + percent)
        self.slack = np.where(self.differ > 0, 2 + self.differ // 4, 0)
        self.buckets = self.differ + 1 + self.slack
        self.largest = largest

    def differing(self, size: np.ndarray) -> np.ndarray:
        """Elements in which a set of ``size`` differs from a linked one at most."""
        return (100 - self.percent) * (size + size * 100 // self.percent) // (100 + self.percent)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, size, side="right") - 1


def _cell_keys(doc: np.ndarray, value: np.ndarray, size: np.ndarray, level: np.ndarray, fits: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, cell) of the documents that ``fits`` marks, under size class ``level`` of each, and how many of a set's cells must have other sets."""
    mine = fits[doc]
    doc, value = doc[mine], value[mine]
    total = classes.buckets[level]
    bucket = ((value >> np.uint64(32)) * total[doc].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    owner, which = doc[at], bucket[at]
    content = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at) if len(at) else np.empty(0, np.uint64)
    content = content + np.diff(np.append(at, len(doc))).astype(np.uint64)
    at_level = mix(level.astype(np.uint64) + np.uint64(77))
    key = mix(content + which * np.uint64(0xC2B2AE3D27D4EB4F) + at_level[owner])
    empty = np.where(fits, total - np.bincount(owner, minlength=len(fits)), 0)
    # Linked sets have all buckets alike but for those of their differing elements; not more empty ones than each leaves out count.
    need = np.maximum(1, total - classes.differing(size) - np.minimum(empty, classes.slack[level]))
    # Sets with more empty buckets than the slack meet in those as well.
    sparse = np.flatnonzero(fits & (empty > classes.slack[level]))
    if len(sparse):
        starts = np.cumsum(total[sparse]) - total[sparse]
        free = np.ones(int(total[sparse].sum()), bool)
        place = np.full(len(fits), -1)
        place[sparse] = starts
        held = place[owner] >= 0
        free[place[owner[held]] + which[held].astype(np.int64)] = False
        of = np.repeat(sparse, total[sparse])
        number = (np.arange(len(free)) - np.repeat(starts, total[sparse])).astype(np.uint64)
        more = mix(number * np.uint64(0x9E3779B97F4A7C15) + at_level[of] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(5))
        owner, key = np.concatenate([owner, of[free]]), np.concatenate([key, more[free]])
    return owner, key, need


def _cells_of(doc: np.ndarray, value: np.ndarray, size: np.ndarray, classes: Classes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a set's own size class (0) and the one below it (1): document and cell of each cell, cells needed, and which documents take part."""
    level = classes.of(np.maximum(size, 1))
    for down in (0, 1):
        own = np.maximum(level - down, 0)
        # A set also joins the class below if a linked set of that class can exist.
        fits = (size > 0) & (level >= down) & (classes.differ[own] > 0)
        if down:
            fits &= size * classes.percent <= classes.largest[own] * 100
        yield (down, *_cell_keys(doc, value, size, own, fits, classes), fits)


def _set_keys(doc: np.ndarray, value: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, key and a second key of each document's set; the keys of the empty set mean nothing."""
    size = np.bincount(doc, minlength=count)
    keys = np.zeros((2, count), np.uint64)
    held = np.flatnonzero(size)
    if len(held):
        first = np.concatenate([[0], np.cumsum(size[held])[:-1]])
        for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
            keys[k, held] = mix(np.add.reduceat(mix(value ^ np.uint64(salt)), first) + size[held].astype(np.uint64))
    return size, keys[0], keys[1]


def _sets_in(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of ``batch`` with (document, element) of their texts."""
    data, offsets = text_bytes(batch.column("text"))
    for a, b in chunks(offsets):
        yield (a, b, *element_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words))


def signed_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """row_id, doc_id, n (set size), set_key and check (null for the empty set), cells (number), need_0 and need_1 of every text."""
    classes = Classes(percent)
    names = ["row_id", "doc_id", "n", "set_key", "check", "cells", "need_0", "need_1"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, doc, value in _sets_in(batch, words):
                size, key, check = _set_keys(doc, value, b - a)
                cells, needs = np.zeros(b - a, np.int64), []
                for _, owner, _, need, fits in _cells_of(doc, value, size, classes):
                    cells += np.bincount(owner, minlength=b - a)
                    needs.append(np.where(fits, need, 0))
                columns = [batch.column("row_id")[a:b], batch.column("doc_id")[a:b], pa.array(size.astype(np.int64))]
                columns += [pa.array(k.view(np.int64), mask=size == 0) for k in (key, check)]
                yield pa.record_batch([*columns, *(pa.array(x.astype(np.int64)) for x in (cells, *needs))], names=names)

    return docs.select("row_id", "doc_id", "text").mapInArrow(giving_back(sign), ", ".join(f"{n} long" for n in names))


def _five(values: np.ndarray) -> bytes:
    """The low 40 bits of each value."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def shared_cells(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """(cell, short, down) of the cells that several sets have; ``short`` are the leading 39 bits of a set's key. Rows may repeat."""
    classes = Classes(percent)
    names = ["to", "part", "sure", "cells", "sets"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        done: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def sent() -> Iterator[pa.RecordBatch]:
            cell, of = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((of, cell))
            cell, of = cell[order], of[order]
            first = np.ones(len(cell), bool)
            first[1:] = cell[1:] != cell[:-1]
            last = np.append(first[1:], True)
            part = ((cell >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
            for sure in (False, True):
                at = np.flatnonzero((first | last) != sure)
                if not len(at):
                    continue
                cut = np.flatnonzero(np.diff(part[at], prepend=np.uint64(1 << 40)) != 0)
                stops = [*cut[1:].tolist(), len(at)]
                some = part[at[cut]].astype(np.int64)
                to = (some + int(mix(np.array([turn + 1], np.uint64))[0] % np.uint64(parts))) % parts if sure else some
                packed = [[_five(x[at[a:b]]) for a, b in zip(cut.tolist(), stops, strict=True)] for x in (cell, of)]
                columns = [pa.array(to), pa.array(some), pa.array(np.full(len(some), sure)), *(pa.array(x, pa.binary()) for x in packed)]
                yield pa.record_batch(columns, names=names)

        for batch in batches:
            for a, b, doc, value in _sets_in(batch, words):
                size, key, _ = _set_keys(doc, value, b - a)
                # A set that this task has sent, or has twice here, goes once.
                fresh = np.zeros(b - a, bool)
                for k in np.flatnonzero(size).tolist():
                    if (name := int(key[k])) not in done:
                        done.add(name)
                        fresh[k] = True
                mine = fresh[doc]
                doc, value = doc[mine], value[mine]
                for down, owner, cell, _, _ in _cells_of(doc, value, np.where(fresh, size, 0), classes):
                    held.append((cell, (key[owner] >> np.uint64(25)) << _ONE | np.uint64(down)))
                    count += len(cell)
                if count >= CELLS:
                    yield from sent()
                    held, count = [], 0
        if count:
            yield from sent()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def rows(part: int, cell: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            whole = cell + (np.uint64(part) << np.uint64(40))
            columns = [pa.array(whole.view(np.int64)), pa.array((of >> _ONE).view(np.int64)), pa.array((of & _ONE).astype(np.int64))]
            return pa.record_batch(columns, names=["cell", "short", "down"])

        def closed() -> pa.RecordBatch:
            cell, of = (np.concatenate([_wide(h[k]) for h in held]) for k in (0, 1))
            held.clear()
            order = np.lexsort((of, cell))
            cell, of = cell[order], of[order]
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])
            cell, of = cell[new], of[new]
            alike = np.zeros(len(cell) + 1, bool)
            alike[1:-1] = cell[1:] == cell[:-1]
            several = alike[1:] | alike[:-1]
            return rows(now, cell[several], of[several])

        for batch in batches:
            for part, sure, cells, sets in zip(*(batch.column(c) for c in ("part", "sure", "cells", "sets")), strict=True):
                part = part.as_py()
                if sure.as_py():
                    yield rows(part, _wide(cells.as_py()), _wide(sets.as_py()))
                    continue
                if part != now and held:
                    yield closed()
                now = part
                held.append((cells.as_py(), sets.as_py()))
        if held:
            yield closed()

    packed = docs.select("text").mapInArrow(giving_back(emit), "to long, part long, sure boolean, cells binary, sets binary")
    return packed.repartition("to").sortWithinPartitions("part", "sure").mapInArrow(giving_back(meet), "cell long, short long, down long")


def _apart(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (cell, set_key, ..) of the cells with several values of ``by``, with the cell's number of members and its smallest set as hub."""
    bounds = rows.groupBy("cell").agg(F.min(by).alias("low"), F.max(by).alias("high"), F.min("set_key").alias("hub"), F.count(F.lit(1)).alias("members"))
    bounds = written(bounds.filter("low != high").select("cell", "hub", "members"), "bounds")
    return rows.drop("hub", "members").join(bounds, "cell")


def _enough(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (cell, set_key, down, ..) of the sets that share enough cells in a size class to have a link there."""
    tally = rows.groupBy("set_key", "down").agg(F.count(F.lit(1)).alias("shared"))
    need = F.when(F.col("down") == 0, F.col("need_0")).otherwise(F.col("need_1"))
    stay = tally.join(groups.select("set_key", "need_0", "need_1"), "set_key").filter(F.col("shared") >= need).select("set_key", "down")
    return rows.join(written(stay, "staying"), ["set_key", "down"])


def _bitmap(elements: np.ndarray) -> bytes:
    """A set's size and a bitmap of its hashed elements, of about four times as many bits."""
    width = 64
    while width < min(4 * len(elements), 1 << 15):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(elements & np.uint64(width - 1)).astype(np.int64)] = True
    return len(elements).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def _folded(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of one width, the narrowest one's, and set sizes."""
    sizes = np.array([int.from_bytes(r[:8], "little") for r in raw])
    width = min(len(r) for r in raw) - 8
    maps = [np.bitwise_or.reduce(np.frombuffer(r, np.uint8, offset=8).reshape(-1, width), axis=0) for r in raw]
    return np.stack(maps).view(np.uint64), sizes


def member_sets(docs: DataFrame, words: int, nodes: DataFrame) -> DataFrame:
    """set_key, weight, elements (sorted, eight bytes each) and bitmap of the sets of ``nodes`` (set_key, row_id), a row or more each."""
    side = F.broadcast(nodes) if small_enough(nodes, BROADCAST_ROWS) else nodes
    texts = docs.select("row_id", "text").join(side, "row_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes, bytes]] = []
        held = 0

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            batch = pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["set_key", "weight", "elements", "bitmap"])
            out.clear()
            return batch

        for batch in batches:
            wanted = batch.column("set_key").to_numpy(zero_copy_only=False)
            for a, b, doc, value in _sets_in(batch, words):
                size, key, _ = _set_keys(doc, value, b - a)
                ends = np.concatenate([[0], np.cumsum(size)])
                # Another row may share the id but not the text.
                for d in np.flatnonzero((key.view(np.int64) == wanted[a:b]) & (size > 0)).tolist():
                    own = value[ends[d] : ends[d + 1]]
                    out.append((int(wanted[a + d]), 1 + len(own) // WEIGHT, own.tobytes(), _bitmap(own)))
                    held += len(own)
                    if held > _ELEMENTS:
                        yield rows()
                        held = 0
        yield rows()

    return texts.select("text", "set_key").mapInArrow(giving_back(make), "set_key long, weight long, elements binary, bitmap binary")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """For each remainder of an element by COUNTERS, how many elements of ``sets`` (elements) have it."""
    kind = "slice long, places binary, counts binary"

    def packed(at: int, counts: np.ndarray) -> pa.RecordBatch:
        held = np.flatnonzero(counts)
        columns = [pa.array([at]), pa.array([held.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[held].tobytes()], pa.binary())]
        return pa.record_batch(columns, names=["slice", "places", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column("elements"):
                # A set's elements differ, but two may share a counter.
                np.add.at(total, (np.frombuffer(raw.as_py(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        for at, part in enumerate(total.reshape(-1, _SLICE)):
            if part.any():
                yield packed(at, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "places", "counts")), strict=True):
                totals.setdefault(at, np.zeros(_SLICE, np.int64))[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int64)
        for at, total in totals.items():
            yield packed(at, total)

    added = sets.select("elements").mapInArrow(giving_back(count), kind).repartition("slice").mapInArrow(giving_back(add), kind)
    out = np.zeros((COUNTERS // _SLICE, _SLICE), np.int64)
    for row in written(added, "frequencies").collect():
        out[row["slice"], np.frombuffer(row["places"], np.uint16)] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32).ravel()


def size_bands() -> list[int]:
    """The smallest sizes of bands, beginning at 1."""
    lows, low = [], 1
    while low < 1 << 40:
        lows.append(low)
        low = max(low + 1, low * 10 // 9)
    return lows


def _rare_elements(elements: np.ndarray, often: np.ndarray, lows: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys by which a set (its ``elements``) meets every set that it links with; ``lows`` are the smallest sizes of the bands.

    An element alone in its counter is in no other set, so it has no key.
    """
    n = len(elements)
    count = often[(elements % np.uint64(COUNTERS)).astype(np.int64)]
    order = np.lexsort((elements, count))
    elements, met = mix(elements[order]), count[order] > 1
    own, least, most = np.searchsorted(lows, [n, -(-n * percent // 100), n * 100 // percent], side="right") - 1
    out = []
    for other in range(max(least, 0), most + 1):
        smallest = max(int(lows[other]), -(-n * percent // 100))
        shared = -(-percent * (n + smallest) // (100 + percent))
        early = elements[: max(0, n - shared + 1)]
        # The lower band first: both sets have the same key.
        pair = mix(np.array([min(own, other) << 32 | max(own, other)], np.uint64))[0]
        out.append(mix(early[met[: len(early)]] ^ pair))
    return out


def rare_cells(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(cell, set_key): linked sets of ``left`` (set_key) have a cell alike, made of an element that is among the rarest of both."""
    side = F.broadcast(left) if small_enough(left, BROADCAST_ROWS) else left
    members = sets.select("set_key", "elements").join(side, "set_key")
    often = _frequencies(members)
    bands = np.array(size_bands(), np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, owners, held = [], [], 0

        def rows() -> pa.RecordBatch:
            cell = np.concatenate([np.empty(0, np.uint64), *cells])
            owner = np.repeat(np.array(owners, np.int64), [len(c) for c in cells])
            cells.clear()
            owners.clear()
            return pa.record_batch([pa.array(cell.view(np.int64)), pa.array(owner)], names=["cell", "set_key"])

        for batch in batches:
            for key, raw in zip(batch.column("set_key").to_pylist(), batch.column("elements"), strict=True):
                for cell in _rare_elements(np.frombuffer(raw.as_py(), np.uint64), often, bands, percent):
                    cells.append(cell)
                    owners.append(key)
                    held += len(cell)
                if held > _ELEMENTS:
                    yield rows()
                    held = 0
        yield rows()

    return members.mapInArrow(giving_back(meet), "cell long, set_key long")


def _unit_members(sets: DataFrame, units: DataFrame, what: str) -> DataFrame:
    """``units`` (set_key, i, j, block, label) with the elements, or bitmap, of each set."""
    units = written(units, "units")
    side = F.broadcast(units) if small_enough(units, BROADCAST_ROWS) else units
    return sets.select("set_key", F.col(what).alias("elements")).join(side, "set_key").withColumnRenamed("set_key", "node")


class _Tree:
    """A signature tree over one unit's members; level 0 are the members themselves."""

    def __init__(self, packed: np.ndarray, size: np.ndarray) -> None:
        ones = np.bitwise_count(packed).sum(1, dtype=np.int64)
        #: Per level: bitmaps, smallest and largest size, most bits, most elements hidden behind a bit already set.
        self.levels = [(packed, size, size, ones, size - ones)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, ones, hidden = self.levels[-1]
            cut = np.arange(0, len(low), _FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(ones, cut), np.maximum.reduceat(hidden, cut)))

    def candidates(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members that no pair of their nodes rules out, by a dual traversal level by level."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            maps, low, high, ones, hidden = self.levels[depth]
            if depth < len(self.levels) - 1:
                step = np.arange(_FAN_OUT)
                a = (a[:, None, None] * _FAN_OUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
                b = (b[:, None, None] * _FAN_OUT + step[None, None, :] + 0 * step[None, :, None]).ravel()
                keep = (a <= b) & (b < len(low))
                a, b = a[keep], b[keep]
            if depth == 0:
                apart = a < b
                a, b = a[apart], b[apart]
            parts = []
            for k in range(0, len(a), 4096):
                x, y = a[k : k + 4096], b[k : k + 4096]
                common = np.bitwise_count(maps[x] & maps[y]).sum(1, dtype=np.int64)
                most = np.minimum(hidden[x] + np.minimum(ones[x], common), hidden[y] + np.minimum(ones[y], common))
                most = np.minimum(most, np.minimum(high[x], high[y]))
                # Linked sets share at least percent / (100 + percent) of their sizes' sum, and sizes are within percent.
                fits = (most * (100 + percent) >= percent * (low[x] + low[y])) & (high[x] * 100 >= low[y] * percent) & (high[y] * 100 >= low[x] * percent)
                parts.append(np.flatnonzero(fits) + k)
            kept = np.concatenate(parts) if parts else np.empty(0, np.int64)
            a, b = a[kept], b[kept]
        return a, b


def _links(ids: list[int], labels: list[int], blocks: list[int], raw: list[bytes], percent: int, across: bool) -> list[tuple[int, int]]:
    """A spanning set of the unit's links; members of one label count as connected. ``across``: only pairs from different blocks."""
    sets = [np.frombuffer(r, np.uint64) for r in raw]
    # Copies' neighbours sort together by size and smallest element, which keeps nodes selective.
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]).bit_length(), int(sets[k][0]) if len(sets[k]) else 0, len(sets[k])))
    ids, labels, blocks, sets = ([x[k] for k in order] for x in (ids, labels, blocks, sets))
    root = {x: x for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in _Tree(*_folded([_bitmap(s) for s in sets])).candidates(percent)), strict=True):
        if (across and blocks[i] == blocks[j]) or (p := find(labels[i])) == (q := find(labels[j])):
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if shared * 100 >= percent * (len(sets[i]) + len(sets[j]) - shared):
            root[p] = q
            out.append((ids[i], ids[j]))
    return out


def _candidates(ids: list[int], labels: list[int], blocks: list[int], raw: list[bytes], percent: int, across: bool) -> list[tuple[int, int, int]]:
    """(smaller label, larger label, set) for every set that the bitmaps do not keep from a set of the other label.

    Where many labels meet, the sets once, as a family of their own, for they would be in many pairs of labels.
    """
    packed, sizes = _folded(raw)
    # Alike sets have alike bitmaps and sizes.
    order = np.lexsort((packed[:, 0], sizes))
    a, b = _Tree(packed[order], sizes[order]).candidates(percent)
    label, block = np.array(labels)[order], np.array(blocks)[order]
    apart = (label[a] != label[b]) & ~(across & (block[a] == block[b]))
    a, b = a[apart], b[apart]
    low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
    node = np.array(ids)[order]
    found = np.unique(np.concatenate([np.stack([low, high, node[a]]), np.stack([low, high, node[b]])], axis=1), axis=1)
    once = np.unique(found[2])
    if found.shape[1] > _DENSE * len(once):
        # Neither end is a label: the set of sets names the family, so that cells with the same candidates make one.
        family = int(np.bitwise_xor.reduce(mix(once.view(np.uint64))).view(np.int64))
        return [(family, len(once), x) for x in once.tolist()]
    return [tuple(x) for x in found.T.tolist()]


def _per_unit(members: DataFrame, percent: int, find: Callable, names: list[str]) -> DataFrame:
    """The rows that ``find`` has for each unit. ``members``: i, j (blocks joined; one block if equal), block, label, node, elements."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, out = None, {}, []

        def close() -> None:
            if len(rows) > 1:
                labels, blocks, raw = (list(x) for x in zip(*rows.values(), strict=True))
                out.extend(find(list(rows), labels, blocks, raw, percent, unit[0] != unit[1]))

        def taken() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], names=names)
            out.clear()
            return batch

        for batch in batches:
            elements = batch.column("elements")
            for at, (*key, node, label, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "node", "label", "block")), strict=True)):
                if key != unit:
                    close()
                    unit, rows = key, {}
                    if len(out) > _FOUND:
                        yield taken()
                rows[node] = (label, block, elements[at].as_py())
        close()
        yield taken()

    dealt = members.repartition("i", "j").sortWithinPartitions("i", "j")
    return dealt.mapInArrow(giving_back(join), ", ".join(f"{n} long" for n in names))


def _units(rows: DataFrame, block: int) -> DataFrame:
    """Units (set_key, i, j, block, label) in which all members of a family with different labels meet. ``rows``: family, members (of the family, by weight), set_key, label, weight."""
    one = F.xxhash64("family")
    small = rows.filter(F.col("members") <= block).select("set_key", one.alias("i"), one.alias("j"), F.lit(0).cast("long").alias("block"), "label")
    sets = rows.filter(F.col("members") > block).drop("members")
    if sets.isEmpty():
        return small
    # Of a large family, large labels have blocks of their own and small ones share some.
    sizes = sets.groupBy("family", "label").agg(F.sum("weight").alias("size"))
    pools = sizes.filter(F.col("size") < block).groupBy("family").agg(F.sum("size").alias("pool"))
    sizes = written(sizes.join(pools, "family", "left"), "label-sizes")
    alone = F.col("size") >= block
    own = F.xxhash64("family", "label", F.pmod(F.xxhash64("set_key"), F.ceil(F.col("size") / block)))
    shared = F.xxhash64("family", F.pmod(F.xxhash64("label"), F.ceil(F.col("pool") / block)))
    sets = sets.join(sizes, ["family", "label"]).select("set_key", "label", "family", F.when(alone, own).otherwise(shared).alias("block"), F.when(alone, F.col("label")).alias("whole"))
    sets = written(sets, "blocks-of-sets")
    blocks = written(sets.select("family", "block", "whole").distinct(), "blocks")
    other = blocks.select("family", F.col("block").alias("j"), F.col("whole").alias("other"))
    pairs = blocks.withColumnRenamed("block", "i").join(other, "family").filter((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("whole") == F.col("other"), F.lit(False)))
    pairs = pairs.select("i", "j")
    visits = pairs.select("i", "j", F.col("i").alias("block")).unionByName(pairs.filter("i != j").select("i", "j", F.col("j").alias("block")))
    return small.unionByName(sets.select("set_key", "label", "block").join(written(visits, "visits"), "block").select("set_key", "i", "j", "block", "label"))


def _families(tagged: DataFrame) -> DataFrame:
    """The sets of all cells with the same labels, as a family: family, members (by weight), set_key, label, weight. ``tagged``: cell, set_key, label, weight."""
    labels = tagged.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("sets")).groupBy("cell")
    names = labels.agg(F.xxhash64(F.bit_xor("label"), F.min("label"), F.max("label"), F.count(F.lit(1))).alias("family"))
    rows = tagged.join(written(names, "families"), "cell").select("family", "set_key", "label", "weight")
    return _sized(written(rows.distinct(), "members"))


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (family, weight, ..) with members: the weight of the family."""
    return rows.join(written(rows.groupBy("family").agg(F.sum("weight").alias("members")), "sizes"), "family")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included), a row for each row of ``docs``.

    Only doc_id and text are read. Rows with a null id link like any other, but give no
    component its id; a component without ids has a null id. Ties cannot arise.
    """
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("text", F.lit(0))).alias("row_id"), "doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        return keep(_components_of(docs, words, percent, block).select("doc_id", "n_shingles", "component_id"), "document-components")


def jaccard_rows(docs: DataFrame, words: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """row_id, doc_id and component (any number of the row's component; null for a text without words), a row for each row of ``docs`` (row_id, doc_id, text).

    ``row_id`` tells texts apart also where they share a doc_id.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_components_of(docs.select("row_id", "doc_id", "text"), words, percent, block).select("row_id", "doc_id", "component"), "row-components")


def _components_of(docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """row_id, doc_id, n_shingles, component and component_id of ``docs`` (row_id, doc_id, text)."""
    signed = written(signed_sets(docs, words, percent), "signed")
    groups = signed.filter("set_key is not null").groupBy("set_key")
    groups = groups.agg(
        F.min("row_id").alias("node"),
        F.min("doc_id").alias("least"),
        F.min("check").alias("check"),
        F.max("check").alias("other"),
        *(F.max(c).alias(c) for c in ("cells", "need_0", "need_1")),
    )
    groups = written(groups, "groups")
    seen = groups.agg(F.sum("cells").alias("cells"), F.count_if(F.col("check") != F.col("other")).alias("clashes")).first()
    if seen["clashes"]:
        raise ArithmeticError(f"{seen['clashes']} keys of 64 bits stand for two different sets each")

    # A few sets more share the leading bits of a key: they only add members to be compared.
    cells = written(shared_cells(docs, words, percent, max(1, -(-(seen["cells"] or 0) // CELLS))), "shared-cells")
    names = groups.select("set_key", F.shiftrightunsigned("set_key", 25).alias("short"))
    rows = written(cells.join(names, "short").select("cell", "set_key", "down").distinct(), "named-cells")
    cells = written(_apart(written(_enough(rows, groups), "enough"), "set_key"), "cells")

    nodes = cells.select("set_key").distinct().join(groups.select("set_key", F.col("node").alias("row_id")), "set_key")
    sets = written(member_sets(docs, words, written(nodes, "nodes")), "sets")
    weights = written(sets.groupBy("set_key").agg(F.max("weight").alias("weight")), "weights")

    # Round 1: every set in its most popular cell, blocks of a cell around its hub.
    picked = cells.groupBy("set_key").agg(F.max(F.struct("members", "cell", "hub")).alias("top")).select("set_key", "top.*")
    picked = picked.join(weights, "set_key")
    loads = written(picked.groupBy("cell").agg(F.sum("weight").alias("load")), "loads")
    picked = picked.join(loads, "cell").withColumn("i", F.xxhash64("cell", F.pmod(F.xxhash64("set_key"), F.ceil(F.col("load") / block))))
    picked = written(picked.select("i", "set_key", "hub"), "picked")
    hubs = picked.select("i", F.col("hub").alias("set_key")).distinct()
    units = picked.select("i", "set_key").unionByName(hubs).distinct()
    units = units.withColumns({"j": F.col("i"), "block": F.lit(0).cast("long"), "label": F.col("set_key")})
    first = written(_per_unit(_unit_members(sets, units, "elements"), percent, _links, ["a", "b"]), "links-1")
    labels = written(connected(first).select(F.col("node").alias("set_key"), F.col("component").alias("label")), "labels-1")
    labels = written(weights.join(labels, "set_key", "left").select("set_key", F.coalesce("label", "set_key").alias("label"), "weight"), "labels")

    # Round 2: bitmaps meet where sets of cells that still hold several components have a rare element alike.
    tagged = written(_apart(cells.join(labels, "set_key"), "label"), "mixed")
    tagged = _apart(written(_enough(tagged, groups), "enough"), "label")
    left = written(tagged.select("set_key").distinct(), "left")
    tagged = written(rare_cells(sets, left, percent), "rare-cells").join(labels, "set_key")
    tagged = written(_apart(tagged, "label"), "rare-mixed")
    mixed = _units(_families(tagged), block)
    candidates = _per_unit(_unit_members(sets, mixed, "bitmap"), percent, _candidates, ["low", "high", "node"])
    candidates = candidates.distinct().select(F.xxhash64("low", "high").alias("family"), F.col("node").alias("set_key"))

    # Round 3: sets meet where two components may be linked.
    pairs = written(candidates.join(labels, "set_key"), "candidates")
    last = _per_unit(_unit_members(sets, _units(_sized(pairs), block), "elements"), percent, _links, ["a", "b"])
    labels = connected(written(first.unionByName(last), "links"))

    # A component is named by the smallest id of its sets.
    tagged = groups.select("set_key", "least").join(labels.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    tagged = written(tagged.withColumn("component", F.coalesce("component", "set_key")), "components")
    names = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tagged.join(names, "component").select("set_key", "component", "component_id")
    rows = signed.select("row_id", "doc_id", F.col("n").alias("n_shingles"), "set_key").join(named, "set_key", "left")
    return rows.select("row_id", "doc_id", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))

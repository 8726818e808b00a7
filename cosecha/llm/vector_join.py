"""Embedding near-duplicates by an exact metric range join over pivots.

Unit vectors are points on a sphere; their angle is a metric, and a cosine of at least
``threshold`` is an angle of at most a radius r. Pivots (vectors of the data, a bounded
number) cut the sphere into cells by nearest pivot. By the triangle inequality a vector
w of cell j can be within r of a member of cell i only if

    angle(w, pivot i) - angle(w, pivot j) <= 2 r   and   angle(w, pivot i) <= reach i + r,

where reach is the largest angle of a member to its pivot. Such a w is copied to cell i
if i < j, so every pair meets once, and cells join without each other. A cell's members
are cut into blocks and its visitors into slices, so no task holds a whole cell, however
many copies it has; a block has as many slices as its own number of visitors asks for.
A block meets its visitors as a matrix product in single precision; products within the
rounding of that width around the threshold are taken again in double precision. Tasks return a count
of links for each vector and a spanning set of links, never the pairs.

Vectors with equal directions are one point with a count. A vector that is null, empty
or zero, or has null or non-finite components, links with nothing; vectors of different
lengths never link, and each length is joined by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cosecha.llm.components import connected
from cosecha.llm.tables import written

#: Members of a cell that one task holds, and visitors that it meets, on average.
BLOCK = 1024
SLICE = 32_768
#: Pivots, at most.
PIVOTS = 1024


def margin(width: int) -> float:
    """Single-precision products of unit vectors of ``width`` components err by less than this."""
    return (width + 8) * 2.0**-23


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def unit_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``unit``: the normalised vector as double-precision bytes, null for vectors that link with nothing."""
    schema = StructType(vectors.schema.fields[:]).add("unit", "binary")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            units: list[bytes | None] = [None] * batch.num_rows
            for width in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == width)
                flat = column.take(pa.array(at)).flatten().cast(pa.float64())
                rows = flat.fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
                # Scaled first, so that squares of very large or small components stay finite.
                scale = np.abs(rows).max(1)
                sound = np.isfinite(scale) & (scale > 0)
                rows = rows[sound] / scale[sound, None]
                rows = rows / np.sqrt((rows * rows).sum(1))[:, None]
                for k, row in zip(at[sound].tolist(), rows.astype("<f8"), strict=True):
                    units[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.binary())], names=[*batch.schema.names, "unit"])

    return vectors.mapInArrow(normalise, schema)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1, 1))


def _in_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` (node, copies, unit) with cell and angle to its pivot."""
    width = pivots.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column("unit"), width), pivots)
                cell = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angles[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

    return points.mapInArrow(place, "node long, copies long, unit binary, cell long, angle double")


def _near(angles: np.ndarray, cell: np.ndarray, reach: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells before its own that a point must visit."""
    own = angles[np.arange(len(cell)), cell]
    near = (angles - own[:, None] <= 2 * radius) & (angles <= reach[None, :] + radius)
    near &= np.arange(angles.shape[1])[None, :] < cell[:, None]
    return np.nonzero(near)


def _visitors(placed: DataFrame, pivots: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
    """How many points of other cells visit each cell: at most one row a cell and task comes back."""
    width = pivots.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                _, visited = _near(_angles(_matrix(batch.column("unit"), width), pivots), batch.column("cell").to_numpy(), reach, radius)
                total += np.bincount(visited, minlength=len(pivots))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(len(pivots), np.int64)
    for r in placed.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the numbers first[k], first[k] + 1, .. (count[k] of them), one after another, with k."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def _visits(placed: DataFrame, pivots: np.ndarray, reach: np.ndarray, blocks: np.ndarray, slices: np.ndarray, radius: float) -> DataFrame:
    """Every point in the units (block, slice) that must see it; ``visitor`` 0 for the unit's own block. ``slices``: of each block."""
    width = pivots.shape[1]
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A point may go to every unit; small steps bound what is built at once.
            step = max(1, 2_000_000 // (int(slices.sum()) + len(pivots)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                node, cell = (batch.column(c).to_numpy() for c in ("node", "cell"))
                mixed = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                home = first[cell] + ((mixed >> np.uint64(20)) % blocks[cell].astype(np.uint64)).astype(np.int64)
                # Visitors of other cells see all blocks of a cell, members its blocks before their own.
                row, visited = _near(_angles(_matrix(batch.column("unit"), width), pivots), cell, reach, radius)
                pair, far = _ranges(first[visited], blocks[visited])
                own, before = _ranges(first[cell], home - first[cell])
                who, block = np.concatenate([row[pair], own]), np.concatenate([far, before])
                part = ((mixed[who] >> np.uint64(40)) % slices[block].astype(np.uint64)).astype(np.int64)
                mine, at_home = _ranges(np.zeros(len(cell), np.int64), slices[home])
                visitor = np.concatenate([np.zeros(len(mine), np.int32), np.ones(len(who), np.int32)])
                # All copies of a point one after another, which the shuffle's compression makes small.
                whose = np.concatenate([mine, who])
                order = np.argsort(whose, kind="stable")
                take = pa.array(whose[order])
                columns = [pa.array(np.concatenate([home[mine], block])[order]), pa.array(np.concatenate([at_home, part])[order]), pa.array(visitor[order])]
                columns += [batch.column(c).take(take) for c in ("node", "copies", "unit")]
                yield pa.record_batch(columns, names=["block", "part", "visitor", "node", "copies", "unit"])

    return placed.mapInArrow(send, "block long, part long, visitor int, node long, copies long, unit binary")


class _Unit:
    """One block of points and the links found so far."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, vectors: np.ndarray, threshold: float) -> None:
        self.node, self.copies, self.vectors, self.threshold = node, copies, vectors, threshold
        self.single = vectors.astype(np.float32)
        self.label = np.arange(len(node))
        self.links = np.zeros(len(node), np.int64)
        self.margin = margin(vectors.shape[1])

    def _linked(self, vectors: np.ndarray) -> np.ndarray:
        near = self.single @ vectors.astype(np.float32).T
        linked = near >= self.threshold
        i, j = np.nonzero(np.abs(near - np.float32(self.threshold)) < self.margin)
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            linked[p, q] = (self.vectors[p] * vectors[q]).sum(1) >= self.threshold
        return linked

    def _merge(self, linked: np.ndarray) -> None:
        """Join the labels of points that a column of ``linked`` has in common."""
        while True:
            labels = self.label
            lowest = np.where(linked, labels[:, None], len(labels)).min(0)
            new = np.minimum(np.where(linked, lowest[None, :], len(labels)).min(1), labels)
            # All points of a label move with the lowest of them.
            to = np.arange(len(labels))
            np.minimum.at(to, labels, new)
            moved = to[labels]
            if (moved == labels).all():
                return
            self.label = moved

    def among(self) -> None:
        """Links within the block."""
        linked = self._linked(self.vectors)
        np.fill_diagonal(linked, False)
        if linked.any():
            self.links += (linked.astype(np.float64) @ self.copies).astype(np.int64)
            # A point stands in its own column too, so that its links join it to their columns.
            np.fill_diagonal(linked, True)
            self._merge(linked)

    def meet(self, node: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links with visitors: for those that have any, (node, links, a linked node of the block)."""
        out = []
        for at in range(0, len(node), 4096):
            linked = self._linked(vectors[at : at + 4096])
            columns = np.flatnonzero(linked.any(0))
            if not len(columns):
                continue
            rows = np.flatnonzero(linked.any(1))
            small = linked[np.ix_(rows, columns)]
            self.links[rows] += (small.astype(np.float64) @ copies[at + columns]).astype(np.int64)
            full = np.zeros((len(self.node), len(columns)), bool)
            full[rows] = small
            self._merge(full)
            out.append((node[at + columns], (small.T.astype(np.float64) @ self.copies[rows]).astype(np.int64), self.node[rows[small.argmax(0)]]))
        return out

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        return self.node[has], self.links[has], self.node[self.label[has]]


def _found(visits: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, links, peer): partial counts, and a spanning set of links (node, peer)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, waiting = None, None, []

        def rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for part in found:
                if len(part[0]):
                    yield pa.record_batch([pa.array(x.astype(np.int64)) for x in part], names=["node", "links", "peer"])

        def opened() -> _Unit:
            made = _Unit(*(np.concatenate(x) for x in zip(*waiting, strict=True)), threshold)
            if key[1] == 0:
                made.among()
            waiting.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            block, part, visitor = (batch.column(c).to_numpy() for c in ("block", "part", "visitor"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(visitor) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if (now := (int(block[a]), int(part[a]))) != key:
                    if waiting:
                        unit = opened()
                    if unit is not None:
                        yield from rows([unit.close()])
                    key, unit = now, None
                run = batch.slice(a, b - a)
                points = run.column("node").to_numpy(), run.column("copies").to_numpy(), _matrix(run.column("unit"), width)
                if not visitor[a]:
                    waiting.append(points)
                elif waiting or unit is not None:
                    if waiting:
                        unit = opened()
                    yield from rows(unit.meet(*points))
        if waiting:
            unit = opened()
        if unit is not None:
            yield from rows([unit.close()])

    dealt = visits.repartition("block", "part").sortWithinPartitions("block", "part", "visitor")
    return dealt.mapInArrow(join, "node long, links long, peer long")


def _links_of(points: DataFrame, width: int, count: int, threshold: float, block: int, slice_: int, pivots: int) -> DataFrame:
    """(node, links, peer) of ``count`` points of one length."""
    radius = math.acos(threshold) + 1e-6
    # Pivots: the points of smallest hash, as many as make cells of a few blocks.
    most = min(pivots, max(4, count // (2 * block)))
    chosen = points.orderBy(F.xxhash64("node"), "node").limit(most).select("unit").collect()
    centres = np.stack([np.frombuffer(r["unit"], "<f8") for r in chosen])
    placed = written(_in_cells(points.select("node", "copies", "unit"), centres), "placed")
    # One row for each pivot.
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")).collect()
    reach, members = np.full(len(centres), -math.inf), np.zeros(len(centres), np.int64)
    for r in sizes:
        reach[r["cell"]], members[r["cell"]] = r["reach"], r["n"]
    blocks = np.maximum(-(-members // block), 1)
    placed = placed.select("node", "copies", "unit", "cell")
    # A block is visited from other cells and by the members of later blocks of its own.
    cell, number = _ranges(np.zeros(len(blocks), np.int64), blocks)
    guests = _visitors(placed, centres, reach, radius)[cell] + members[cell] - np.minimum((number + 1) * block, members[cell])
    slices = np.maximum(-(-guests // slice_), 1)
    return written(_found(_visits(placed, centres, reach, blocks, slices, radius), width, threshold), "found")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, slice_: int = SLICE, pivots: int = PIVOTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row of ``vectors``; other columns are not read.

    Rows with a null id link like any other, but give no component its id and are not
    kept; a component without ids has a null one. Rows that repeat an id are vectors of
    their own. ``threshold`` must be above 0.
    """
    narrow = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    units = unit_vectors(narrow).withColumn("node", F.xxhash64("unit")).drop("embedding")
    units = written(units.withColumn("node", F.when(F.col("unit").isNotNull(), F.col("node"))), "units")
    points = units.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"))
    points = written(points.withColumn("width", (F.octet_length("unit") / 8).cast("int")), "points")
    # One row for each length of vector.
    widths = points.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect()
    if not widths:
        return narrow.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    found = None
    for r in widths:
        part = _links_of(points.filter(F.col("width") == r["width"]), r["width"], r["n"], threshold, block, slice_, pivots)
        found = part if found is None else found.unionByName(part)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    tagged = points.select("node", "copies", "least").join(links, "node", "left").join(parts, "node", "left")
    tagged = written(tagged.withColumn("component", F.coalesce("component", "node")), "tagged")
    names = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tagged.join(names, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    rows = units.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

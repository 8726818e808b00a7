"""The prefix trie of conversations, from mergeable partial tries.

A node is a distinct sequence of first turns. Its key is its depth and two 64-bit lanes, each the
exclusive or of a hash of (place, turn) over the sequence: a parent's key is a child's key without the
child's own turn, and running values of slices can be put together in any order. Tasks combine the
nodes of the paths that they hold into partial tables (members, smallest member), and rounds of
hash-keyed merges, with fewer shares each, add those up to one row a node. Which conversations end at
a node is merged as ordered runs of ids, so that no list is held whole.

The rollup goes bottom-up by paths: a conversation owns the nodes of which it is the smallest member,
and these are the lower end of its path. Sums run from that end upwards, and the total of each owned
path is then added to the nodes that it hangs below, in one more merge, whatever the depth.

No task holds a conversation, a node's members or a node's children: places are numbered and summed in
slices, and what many rows look up is either sliced too or has a proven bound (``HEAVY``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.llm.tables import scratch, written

#: Turns of a path that one task numbers or sums at a time.
SLICE = 1024
#: Shares of the partial tries in each round of merges.
SHARES = (64, 1)
#: Parents with over a HEAVY-th of all attached paths below them: there are fewer than HEAVY of these.
HEAVY = 100_000
#: And over this many, below which no group is worth a broadcast.
MANY = 4096
#: Bytes of joined ids in one run.
RUN_BYTES = 64 << 10
#: Code points of a text by which turns that tie in number and role are ordered, before its checksum.
TIE_CHARS = 64

_KEY = ["depth", "a", "b"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, chars, first, last): the places from 1 that equal rows take in their conversation.

    Order is by turn, null first; ties by role, then by the text's first 64 code points, then by
    its checksum. A null role or text is empty. Rows without a conv_id belong to no conversation.
    Equal rows are counted before they move; texts do not move at all.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.substring(text, 1, TIE_CHARS).alias("head"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    parts = counted.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part", "conv_id").orderBy(*order)
    local = written(parts.select("conv_id", "part", "digest", "chars", "n", F.sum("n").over(within).alias("upto")), "turn-parts")
    sizes = local.groupBy("conv_id", "part").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A part goes on with at most one conversation of the parts before it, so these are no more rows than parts.
    offsets = sizes.select("conv_id", "part", F.sum("size").over(earlier).alias("before")).filter("before > 0")
    last = F.col("upto") + F.coalesce("before", F.lit(0))
    placed = local.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", "digest", "chars", (last - F.col("n") + 1).alias("first"), last.alias("last"))


def _slices(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / SLICE), F.floor(last / SLICE)))


def rebuilt_conversations(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilding of ``turns`` (from ``ordered_turns``, written).

    Gives (conv_id, place, digest, chars), a row for each rebuilt turn, and (conv_id, length), a row
    for each conversation, turnless ones included.
    """
    sizes = written(turns.groupBy("conv_id").agg(F.max("last").alias("size")), "conversation-sizes")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    own = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = sizes.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    k = F.least("h", F.coalesce("base_size", F.lit(0)))
    plan = own.join(bases, "base", "left").select("conv_id", "base", "size", "h", k.alias("k"), (k + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))
    plan = written(plan, "rebuilding")

    # Own turns after the first h: slices keep a conversation of any length in many groups.
    spread = turns.filter(F.col("last") > h).select("*", _slices(F.greatest("first", h + 1), F.col("last")).alias("slice"))
    begin, end = F.greatest("first", h + 1, F.col("slice") * SLICE), F.least(F.col("last"), (F.col("slice") + 1) * SLICE - 1)
    tail = spread.select("conv_id", "slice", "digest", "chars", F.explode(F.sequence(begin, end)).alias("turn_no"))
    shifts = plan.select("conv_id", (F.col("k") - F.col("h")).alias("shift"), _slices(F.lit(0), F.col("size")).alias("slice"))
    tail = tail.join(shifts, ["conv_id", "slice"]).select("conv_id", (F.col("turn_no") + F.col("shift")).alias("place"), "digest", "chars")

    # First turns of the base: at most ``most`` - 1 for each of at most ``group`` conversations.
    firsts = turns.filter((F.col("conv_id") % group == 0) & (F.col("first") < most))
    firsts = firsts.select(F.col("conv_id").alias("base"), "digest", "chars", F.explode(F.sequence("first", F.least("last", F.lit(most - 1).cast("long")))).alias("place"))
    head = plan.filter("k > 0").select("conv_id", "base", "k").join(firsts, "base").filter("place <= k").select("conv_id", "place", "digest", "chars")
    return head.unionByName(tail), plan.select("conv_id", "length")


def _running(rows: DataFrame, place: str, combine, columns: Sequence[str], name: str) -> DataFrame:
    """``rows`` (written by this) with the running ``combine`` of ``columns`` along ``place`` in each conversation."""
    within = Window.partitionBy("conv_id", "slice").orderBy(place)
    sliced = rows.withColumn("slice", F.floor(F.col(place) / SLICE))
    local = written(sliced.select("*", *[combine(c).over(within).alias(f"{c}_run") for c in columns]), name)
    totals = local.groupBy("conv_id", "slice").agg(*[combine(c).alias(c) for c in columns])
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "slice", *[combine(c).over(earlier).alias(f"{c}_before") for c in columns])
    return local.join(before.filter(F.col(f"{columns[0]}_before").isNotNull()), ["conv_id", "slice"], "left")


def _merged(rows: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Partial tables added up by key in rounds, each over fewer shares of the tables than the one before."""
    share = F.xxhash64("conv_id")
    rows = rows.withColumn("share", share)
    for shares in SHARES:
        rows = rows.withColumn("share", F.pmod(F.col("share"), F.lit(shares)))
        rows = rows.groupBy(*keys, "share").agg(*[total.alias(c) for c, total in sums.items()])
    return rows.drop("share")


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids, joined by commas, of rows sorted by node and id."""
    key, first, ids, size = None, 0, [], 0
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        members = batch.column(3).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for begin, end in zip([0, *changes.tolist()], [*changes.tolist(), len(members)]):
            if begin == end:
                continue
            here = tuple(int(c[begin]) for c in columns)
            if ids and (here != key or size > RUN_BYTES):
                out.append((*key, first, b",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = here, int(members[begin])
            ids.append(",".join(map(str, members[begin:end].tolist())).encode())
            size += len(ids[-1])
        if out:
            yield _run_batch(out)
    if ids:
        yield _run_batch([(*key, first, b",".join(ids))])


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*_KEY, "first", "ids"])


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's runs, sorted by node and first id; one run is held at a time."""
    key, state = None, None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        out = []
        for depth, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, a, b) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, a, b), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        if out:
            yield rows(out)
    if key is not None:
        yield rows([(*key, state.hexdigest())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from ``ends`` (depth, a, b, conv_id).

    SHA-256 is a chain, so a node's list is hashed in one task; it gets it as runs of about
    64 KB that other tasks joined, and streams them.
    """
    ranged = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    runs = ranged.mapInArrow(_joined_runs, "depth long, a long, b long, first long, ids binary")
    dealt = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(_hashed_runs, "depth long, a long, b long, ends_sha256 string")


def _owners_above(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, above): the owner of the node that each owned path hangs below."""
    parent = ["up", "pa", "pb"]
    owners = nodes.select(F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    below = tops.groupBy(*parent).agg(F.count(F.lit(1)).alias("n"))
    many = max(MANY, tops.count() // HEAVY)
    # Fewer than HEAVY groups can hold more than a HEAVY-th of the rows each; no other group is larger than that.
    heavy = written(owners.join(F.broadcast(below.filter(F.col("n") > many).drop("n")), parent), "heavy-parents")
    marked = tops.join(F.broadcast(heavy), parent, "left")
    rest = marked.filter("above is null").drop("above").join(owners, parent)
    return marked.filter("above is not null").unionByName(rest).select("conv_id", (F.col("up") + 1).alias("depth"), "above")


def trie_nodes(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of sequences.

    ``steps`` has a row for each element of a sequence (conv_id, place from 1, digest, chars), ``lengths``
    one for each sequence (conv_id, length), empty ones included. Without sequences there is no node.
    Equal sequences share all their nodes. Gives a row for each node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    with scratch(lengths.sparkSession) as keep:
        lengths = written(lengths, "lengths")
        lanes = [F.xxhash64(F.lit(k), F.col("place"), F.col("digest")).alias(c) for k, c in ((1, "a"), (2, "b"))]
        run = _running(steps.select("conv_id", "place", "chars", *lanes), "place", F.bit_xor, ["a", "b"], "lanes")
        a, b = (F.col(f"{c}_run").bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0).cast("long"))) for c in "ab")
        below = run.select("conv_id", F.col("place").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("a")).alias("pa"), b.bitwiseXOR(F.col("b")).alias("pb"), "chars")
        zero = F.lit(0).cast("long")
        root = lengths.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("chars"))
        paths = written(root.unionByName(below), "paths")

        first = paths.withColumn("n_convs", F.lit(1).cast("long")).withColumn("member", F.col("conv_id"))
        sums = {"member": F.min("member"), "n_convs": F.sum("n_convs"), "pa": F.max("pa"), "pb": F.max("pb"), "chars": F.max("chars")}
        nodes = written(_merged(first, _KEY, sums).withColumnRenamed("member", "conv_id"), "nodes")
        up = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
        nodes = nodes.join(up.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children")), _KEY, "left").fillna(0, ["n_children"])
        leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")

        # Upwards along each owned path, from its lower end.
        owned = nodes.select("*", (-F.col("depth")).alias("rise"), leaf.alias("leaves"), saved.alias("saved"))
        owned = written(_running(owned, "rise", F.sum, ["leaves", "saved"], "owned"), "owned-sums")
        top = F.min(F.struct("depth", "pa", "pb"))
        ways = owned.groupBy("conv_id").agg(top.alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).filter("top.depth > 0")
        ways = written(ways.select("conv_id", (F.col("top.depth") - 1).alias("up"), "top.pa", "top.pb", "leaves", "saved"), "owned-paths")
        # And each path's total to the nodes above it, which other conversations own.
        reach = ways.select("conv_id", "up", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"), _slices(F.lit(0), F.col("up")).alias("slice"))
        above = paths.withColumn("slice", F.floor(F.col("depth") / SLICE)).join(reach, ["conv_id", "slice"]).filter("depth <= up")
        risen = _merged(above.select("conv_id", *_KEY, "more_leaves", "more_saved"), _KEY, {c: F.sum(c) for c in ("more_leaves", "more_saved")})

        ends = paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(*_KEY, "conv_id")
        hung = _owners_above(ways.select("conv_id", "up", "pa", "pb"), nodes)
        whole = owned.join(risen, _KEY, "left").join(end_hashes(ends), _KEY, "left").join(hung, ["conv_id", "depth"], "left")
        total = lambda c: (F.col(f"{c}_run") + F.coalesce(f"{c}_before", F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0))).cast("long")
        out = whole.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            total("leaves").alias("n_leaves"),
            total("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
        return keep(out, "trie")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns over the rebuilt conversations of a table (conv_id, turn, role, text)."""
    with scratch(conversations.sparkSession) as keep:
        turns = written(ordered_turns(conversations), "turns")
        return keep(trie_nodes(*rebuilt_conversations(turns)), "trie")

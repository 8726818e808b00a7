"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash that depends on nothing else, read as a number u in
(0, 1); a record goes to the shard with the largest weight / -ln(u), the smallest
number on ties. A new shard therefore takes records only into itself, and a shard that
goes gives its records to all others in proportion to their weights. All of it is a
projection; rows move only to be numbered within their shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.llm.tables import free_name, written

#: Pieces that a shard is numbered in.
SLICES = 1024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of ``key``; shards of weight 0 get nothing. A null key is a key like any other."""
    if not any(w > 0 for w in weights):
        raise ValueError("some shard must have a weight above 0")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 53 random bits, moved off 0 and 1.
            u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
            scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def numbered(rows: DataFrame, shard: str, key: str, slot: str = "slot", slices: int = SLICES) -> DataFrame:
    """``rows`` (a written table) with gapless numbers from 0 within each shard, in order of a hash of ``key``.

    A shard is numbered in slices, so no task sees a whole shard. Rows that repeat a key
    get different numbers, in any order among equal rows.
    """
    slice_, count, start, place = (free_name(n, rows.columns) for n in ("_slice", "_rows", "_start", "_place"))
    others = [c for c in rows.columns if c not in (shard, key)]
    # The whole row decides the slice, so that rows without a key, or with one key, are not all in one.
    rows = rows.withColumn(slice_, F.pmod(F.xxhash64(key, *others), slices))
    counts = rows.groupBy(shard, slice_).agg(F.count(F.lit(1)).alias(count))
    # At most shards x slices rows.
    before = Window.partitionBy(shard).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, slice_, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(shard, slice_).orderBy(F.xxhash64(key, F.lit(1)), key, *others)
    placed = rows.withColumn(place, F.row_number().over(within) - 1).join(starts, [shard, slice_])
    return placed.withColumn(slot, (F.col(start) + F.col(place)).cast("long")).drop(slice_, start, place)


def shard_records(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", grown_weight: float | None = None) -> DataFrame:
    """``docs`` with shard (int), and grown_shard: where a record would be with one more shard of ``grown_weight``."""
    out = docs.withColumn("shard", shard_of(F.col(key), weights))
    if grown_weight is not None:
        out = out.withColumn("grown_shard", shard_of(F.col(key), [*weights, grown_weight]))
    return out


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's columns under the law ``key``: doc_id and the number of shards decide.

    A null text has size 8 and the checksum of no bytes; a null doc_id is one key. Rows
    that repeat a doc_id share its shard and have slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    placed = written(shard_records(narrow, [1.0] * shards, grown_weight=1.0), "shards")
    return numbered(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

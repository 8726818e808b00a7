"""Connected components of very large, possibly star-shaped graphs, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosecha.llm.tables import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(written(least, "large"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(large.filter("a != b").distinct(), "large-star")
    least = written(large.groupBy("a").agg(F.min("b").alias("m")), "small")
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b; long), the smallest node it can reach.

    Edges with a null end and loops are ignored; an edge may be repeated and may have
    either direction. Nothing is collected but two numbers a round.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(ends.filter(edges["a"].isNotNull() & edges["b"].isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    before = None
    while (now := current.agg(mark).first()[0]) != before:
        before = now
        if now[0] == 0:
            break
        current = written(_stars(current), "stars")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

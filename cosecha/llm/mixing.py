"""Mixing sources to target weights by Poisson replication.

A source with n documents and target share w of a mix of T documents is repeated
w * T / n times on average: its rate. Each document draws its number of copies from a
Poisson distribution of that rate, by inverting it at a number in (0, 1) that a hash of
the seed and the document gives, so the draw does not depend on partitions or order and
a lost task draws the same again. The copies are dealt out by a second hash: a global
shuffle.

Large rates are drawn as a sum of independent draws of rate at most ``STEP``, which a
table of STEP-sized distribution functions inverts without underflow.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosecha.llm.tables import free_name, written

STEP = 16.0
#: Terms of a distribution function: above them a draw of rate STEP has a chance below 1e-16.
TERMS = 80


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson distribution; the rate is at most STEP."""
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda held, k: F.struct((held["term"] * rate / k).alias("term"), F.concat(held["sums"], F.array(F.element_at(held["sums"], -1) + held["term"] * rate / k)).alias("sums")),
        lambda held: held["sums"],
    )


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, size: float | None = None, source: str = "source") -> DataFrame:
    """(source, documents, rate): one row per source, a null source being one of its own.

    ``weights``: target shares by source, scaled to a sum of 1; a source they leave out
    gets none. Without them a source's share is its count to the power ``temperature``.
    ``size``: documents of the mix on average, by default as many as there are.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    if weights is None:
        share = F.pow(F.col("documents").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    counts = written(counts.withColumn("share", share), "sources")
    total = counts.agg(F.sum("share").alias("shares"), F.sum("documents").alias("all")).first()
    if not total["shares"]:
        return counts.select("source", "documents", F.lit(0.0).alias("rate"))
    goal = float(total["all"] if size is None else size)
    return counts.select("source", "documents", (F.col("share") / F.lit(total["shares"]) * F.lit(goal) / F.col("documents")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, size: float | None = None, seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix: each row of ``docs`` as often as drawn, with copy (from 0), rate and shuffle_key, in order of shuffle_key.

    Columns of these three names are replaced; all others are kept. Rows that repeat a
    key draw alike. A null key is a key like any other.
    """
    docs = docs.drop("copy", "rate", "shuffle_key")
    own, steps_, table, copies_ = (free_name(n, docs.columns) for n in ("_source", "_steps", "_table", "_copies"))
    rates = source_rates(docs, weights, temperature, size, source).filter("rate > 0")
    steps = F.ceil(F.col("rate") / STEP)
    rates = rates.select(F.col("source").alias(own), "rate", steps.alias(steps_), _distribution(F.col("rate") / F.nullif(steps, F.lit(0))).alias(table))
    joined = docs.join(written(rates, "rates"), F.col(source).eqNullSafe(F.col(own))).drop(own)
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    # Inversion: as many copies as distribution values lie below the draw.
    draw = lambda step: F.size(F.filter(table, lambda p: p <= _unit(name, F.lit(seed), step)))
    copies = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col(steps_)), F.lit(0), lambda total, step: total + draw(step))
    drawn = joined.withColumn(copies_, copies).filter(F.col(copies_) > 0)
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(copies_) - 1))).drop(copies_, steps_, table)
    each = each.withColumn("shuffle_key", F.xxhash64(name, F.lit(seed), F.lit("place"), F.col("copy")))
    return each.orderBy("shuffle_key", key, "copy")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, copy, rate and shuffle_key of the mix of square-root weights, as large as the input."""
    return mix_sources(docs.select("doc_id", "source", "text"))

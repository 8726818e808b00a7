"""Conforming raw names to dimension members, merging duplicates, and reports on what is left."""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cosecha.functions.columns import first_per_key
from cosecha.functions.names import normalized
from cosecha.functions.text import comparison_key, norm_key
from cosecha.session import shared_folder

#: Dimension rows that may be sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Characters from rare to frequent in names; what is not among them is rarest. Any order is right, this one is quick.
RARE_FIRST = "0123456789wkxqyjzfhvgbpmctudlnrsioea "
#: Characters of a key from which its marks are single letters.
PAIRED = 256


def table(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of its own in the shared folder."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def resolve(staging: DataFrame, raw: str, aliases: DataFrame, members: DataFrame) -> DataFrame:
    """``staging`` with member_id and how it was found: by its exact alias, by the alias of its repaired text, by a member of that name, or not at all.

    ``aliases``: raw_value, member_id. ``members``: member_id, name. Repaired is a text with single blanks and
    its inner accents lower-cased; case and accents count. Each distinct raw value is resolved once; what several
    members share goes to the smallest id.
    """
    values = staging.select(F.col(raw).alias("raw_value")).distinct().withColumn("_name", normalized(F.col("raw_value")))
    exact = aliases.groupBy("raw_value").agg(F.min("member_id").alias("by_alias"))
    again = exact.select(F.col("raw_value").alias("_name"), F.col("by_alias").alias("by_key"))
    named = members.groupBy(F.col("name").alias("_name")).agg(F.min("member_id").alias("by_name"))
    found = values.join(exact, "raw_value", "left").join(again, "_name", "left").join(named, "_name", "left")
    how = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_key").isNotNull(), "alias_key").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    found = found.select(F.col("raw_value").alias(raw), F.coalesce("by_alias", "by_key", "by_name").alias("member_id"), how.alias("resolved_by"))
    return staging.join(found, raw, "left")


def gaps(resolved: DataFrame, raw: str) -> DataFrame:
    """Raw values that nothing resolves, with their rows, most frequent first."""
    missing = resolved.filter("member_id is null").groupBy(raw).agg(F.count(F.lit(1)).alias("rows"))
    return missing.orderBy(F.desc("rows"), raw)


def closed_merges(merges: DataFrame) -> DataFrame:
    """(loser, winner) with chains followed to their end, by doubling the path in each round.

    A loser with several winners has the smallest. The members of a cycle, and those that
    lead to it, go to the cycle's smallest member, which is no loser. Each round is a
    table in the shared folder, so the plan does not grow.
    """
    pairs = merges.filter("loser != winner").groupBy("loser").agg(F.min("winner").alias("winner"))
    current = table(pairs.withColumn("least", F.least("loser", "winner")), "merges")
    total, reach = current.count(), 1
    onward = lambda rows: rows.select(F.col("loser").alias("winner"), F.col("winner").alias("_next"), F.col("least").alias("_least"))
    while reach < 2 * total:
        following = current.join(onward(current), "winner", "left")
        if following.filter("_next is not null").isEmpty():
            return current.select("loser", "winner")
        current = table(following.select("loser", F.coalesce("_next", "winner").alias("winner"), F.least("least", "_least").alias("least")), "merges")
        reach *= 2
    # Whatever has a next one still goes round; its winner lies on the cycle and has seen all of it.
    ends = current.join(onward(current), "winner", "left")
    return ends.select("loser", F.coalesce("_least", "winner").alias("winner")).filter("loser != winner")


def rewrite_keys(facts: DataFrame, key: str, merges: DataFrame) -> DataFrame:
    """``facts`` with merged members of ``key`` replaced by their winners."""
    closed = merges.select(F.col("loser").alias(key), F.col("winner").alias("_winner"))
    return facts.join(closed, key, "left").withColumn(key, F.coalesce("_winner", key)).drop("_winner").select(*facts.columns)


def duplicate_groups(members: DataFrame, name: str = "name") -> DataFrame:
    """Keys that several members share, with how many; names without letters and digits have none."""
    keyed = members.groupBy(norm_key(F.col(name)).alias("norm_key")).agg(F.count(F.lit(1)).alias("members"), F.min("member_id").alias("smallest"))
    return keyed.filter("members > 1 and norm_key != ''")


def survivors(members: DataFrame, references: DataFrame, before: DataFrame) -> DataFrame:
    """(loser, winner): members that are new since ``before`` (member_id) go to the most referenced older one of their key, the smaller id on ties.

    Older members are never merged, and new ones without an older one stay for a person to decide.
    """
    counts = references.groupBy("member_id").agg(F.count(F.lit(1)).alias("uses"))
    older = before.select("member_id", F.lit(True).alias("older")).distinct()
    rows = members.join(counts, "member_id", "left").join(older, "member_id", "left").withColumn("norm_key", norm_key(F.col("name"))).filter("norm_key != ''")
    anchors = rows.filter("older").withColumn("uses", F.coalesce("uses", F.lit(0)))
    best = first_per_key(anchors, ["norm_key"], F.desc("uses"), F.asc("member_id")).select("norm_key", F.col("member_id").alias("winner"))
    return rows.filter("older is null").join(best, "norm_key").select(F.col("member_id").alias("loser"), "winner")


def most_frequent_parent(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """The parent that a child appears with most often, the smaller on ties."""
    counts = rows.filter(F.col(parent).isNotNull()).groupBy(child, parent).agg(F.count(F.lit(1)).alias("rows"))
    return first_per_key(counts, [child], F.desc("rows"), F.asc(parent))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts; 0 where either is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b, strict=True)])


def _tokens(key: Column) -> Column:
    """The characters of a key, each with how often it stood before it: what two keys share of these is what they share of letters. Rare ones come first."""
    each = lambda c: F.transform(
        F.sequence(F.lit(1), F.length(key) - F.length(F.replace(key, c, F.lit("")))), lambda k: F.struct((-k).alias("k"), F.instr(F.lit(RARE_FIRST), c).alias("r"), c.alias("c"))
    )
    numbered = F.flatten(F.transform(F.array_distinct(F.split(key, "")), each))
    return F.transform(F.sort_array(numbered), lambda t: F.concat(t["c"], t["k"].cast("string")))


def _signatures(keys: DataFrame, key: str, threshold: float, reach: Sequence[int]) -> DataFrame:
    """(key, tokens, band, mark): what a key must share with one of length band ``band``, for its own band and those ``reach`` beside it.

    A ratio t of 2 m / (a + b) needs m >= t a / (2 - t) shared tokens whatever b is, so of the first a - m + s tokens of each,
    rare ones first, s are shared. s is two from a length on where two must be, so marks are pairs; one for single letters and very long keys.
    """
    span = (2 - threshold) / threshold * (1 + 1e-9)
    size = F.length(key)
    rows = keys.withColumns({"tokens": _tokens(F.col(key)), "_own": F.floor(F.log(size.cast("double")) / math.log(span))})
    rows = rows.withColumn("band", F.explode(F.array(*[F.col("_own") + k for k in reach])))
    shortest = F.pow(F.lit(span), F.col("band"))
    pairs = (threshold * shortest / (2 - threshold) > 1.001) & (shortest < PAIRED)
    first = (size - F.ceil(size * (threshold / (2 - threshold)) - 1e-9) + F.when(pairs, 2).otherwise(1)).cast("int")
    rows = rows.withColumn("_first", F.slice("tokens", F.lit(1), first))
    two = F.flatten(F.transform("_first", lambda x, i: F.transform(F.slice("_first", i + 2, F.size("_first")), lambda y: F.xxhash64(x, y))))
    marks = F.when(pairs, two).otherwise(F.transform("_first", lambda x: F.xxhash64(x)))
    return rows.select(key, "tokens", "band", F.explode(marks).alias("mark"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio): all pairs of the distinct keys ``left`` (a) and ``right`` (b) whose matching-blocks ratio reaches ``threshold`` (above 0).

    Pairs meet on marks of rare letters and on length, by an equi-join that loses none; those that share enough letters get
    their ratio. Empty keys are alike only with each other.
    """
    marked = _signatures(left.filter("a != ''"), "a", threshold, (0,)).withColumnRenamed("tokens", "_a")
    others = _signatures(right.filter("b != ''"), "b", threshold, (-1, 0, 1)).withColumnRenamed("tokens", "_b")
    enough = lambda m: 2.0 * m / (F.length("a") + F.length("b")) >= threshold
    met = marked.join(others, ["band", "mark"]).filter(enough(F.least(F.length("a"), F.length("b")))).select("a", "b", "_a", "_b").dropDuplicates(["a", "b"])
    close = met.filter(enough(F.size(F.array_intersect("_a", "_b")))).select("a", "b").withColumn("ratio", matching_ratio("a", "b")).filter(F.col("ratio") >= threshold)
    return close.unionByName(left.filter("a = ''").join(right.filter("b = ''"), F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("ratio")))


def _keyed(texts: DataFrame, text: str, key: str) -> DataFrame:
    """The distinct texts that have a comparison key, with it.

    Conditions on the key would go below the distinct and work it out for every row, so what is distinct is a table first.
    """
    distinct = table(texts.select(text).filter(F.col(text).isNotNull()).distinct(), "texts")
    return table(distinct.withColumn(key, comparison_key(F.col(text))), "keys").filter(F.col(key).isNotNull())


def fuzzy_best(values: DataFrame, members: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The most alike member of each value (value, name, ratio) at or above ``threshold``; the smallest name on ties.

    An equal key is taken first. Keys are distinct before they meet, and names of one key have one ratio.
    """
    keyed = _keyed(values, "value", "a")
    right = _keyed(members, "name", "b").groupBy("b").agg(F.min("name").alias("name"))
    left = keyed.select("a").distinct()
    # From 200 characters on the ratio leaves out frequent ones, also of equal keys.
    same = left.join(right, F.col("a") == F.col("b")).filter(F.length("a") < 200).select("a", "name", F.lit(1.0).alias("ratio"))
    pairs = fuzzy_pairs(left.join(same.select("a"), "a", "left_anti"), right.select("b"), threshold).join(right, "b")
    best = first_per_key(pairs.select("a", "name", "ratio"), ["a"], F.desc("ratio"), F.asc("name")).select("a", "name", "ratio")
    return keyed.join(same.unionByName(best), "a").select("value", "name", "ratio")


def fuzzy_matches(values: DataFrame, members: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Every member of each value (value, name, ratio) at or above ``threshold``."""
    keyed, named = _keyed(values, "value", "a"), _keyed(members, "name", "b")
    pairs = fuzzy_pairs(keyed.select("a").distinct(), named.select("b").distinct(), threshold)
    return keyed.join(pairs, "a").join(named, "b").select("value", "name", "ratio")


def forward_filled(rows: DataFrame, value: str, order: str, within: list[str]) -> Column:
    """The last value that is not null up to each row, in ``order`` inside each of ``within``."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

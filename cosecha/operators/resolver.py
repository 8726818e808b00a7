"""Resolving raw names to members, and creating those that are missing, once and with the same id in every run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosecha.functions.columns import first_per_key
from cosecha.functions.names import normalized
from cosecha.functions.text import split_at_last_comma, strip_accents
from cosecha.operators.conform import resolve, table

# Names that are given to what has none of its own.
OWN_MARKET, GENERAL = "Mercado municipal de ", "General ({0})"


@dataclass(frozen=True)
class Resolution:
    """What was found for distinct raw values (raw_value, member_id, resolved_by), and what must be added to find it again."""

    found: DataFrame
    members: DataFrame
    aliases: DataFrame


def member_id(kind: Column | str, name: Column) -> Column:
    """An id that kind and name decide."""
    return F.sha2(F.concat_ws("\x1f", F.lit(kind) if isinstance(kind, str) else kind, name), 256)


def _added(found: DataFrame, new: DataFrame, aliases: DataFrame) -> Resolution:
    """``found`` with the members of ``new`` (raw_value, member_id, name, parent_id), each with its raw and its repaired text as aliases."""
    texts = new.select("raw_value", "member_id").unionByName(new.select(normalized(F.col("raw_value")).alias("raw_value"), "member_id"))
    fresh = texts.groupBy("raw_value").agg(F.min("member_id").alias("member_id")).join(aliases.select("raw_value"), "raw_value", "left_anti")
    both = found.join(new.select("raw_value", F.col("member_id").alias("_new")), "raw_value", "left")
    how = F.when(F.col("_new").isNotNull(), "created").otherwise(F.col("resolved_by"))
    members = first_per_key(new.select("member_id", "name", "parent_id"), ["member_id"], F.asc_nulls_last("parent_id"), F.asc("name"))
    return Resolution(both.select("raw_value", F.coalesce("member_id", "_new").alias("member_id"), how.alias("resolved_by")), members, fresh)


def _values(values: DataFrame, keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The distinct raw values that are not empty. The distinct ones are a table first, by ``keep``: else every row would be repaired."""
    distinct = values.select("raw_value").distinct()
    return (keep(distinct) if keep else table(distinct, "values")).filter(normalized(F.col("raw_value")) != "")


def resolve_or_create(values: DataFrame, kind: str, members: DataFrame, aliases: DataFrame, parent: Column | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Resolution:
    """Raw values (raw_value, and what ``parent`` reads) against ``members`` (member_id, name) and ``aliases`` (raw_value, member_id).

    An unknown value becomes a member by its repaired text; spellings that are repaired to one text become one member. Of several
    parents of a new member the smallest counts. Empty and null values resolve to nothing.
    """
    found = resolve(_values(values, keep), "raw_value", aliases, members)
    name = normalized(F.col("raw_value"))
    above = values.groupBy("raw_value").agg(F.min(parent if parent is not None else F.lit(None).cast("string")).alias("parent_id"))
    missing = found.filter("member_id is null").select("raw_value").join(above, "raw_value", "left")
    return _added(found, missing.select("raw_value", member_id(kind, name).alias("member_id"), name.alias("name"), "parent_id"), aliases)


def resolve_cities(values: DataFrame, members: DataFrame, aliases: DataFrame, gazetteer: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> Resolution:
    """As ``resolve_or_create``, but a new city must be in the ``gazetteer`` (name, parent, code): by its capitals, else by its capitals without accents.

    A city is created under its repaired raw text, below its department; of several places of one name the one of smallest code counts.
    What the gazetteer lacks stays unresolved.
    """
    found = resolve(_values(values, keep), "raw_value", aliases, members)
    bare = lambda c: F.upper(strip_accents(c))
    exact = first_per_key(gazetteer.withColumn("_key", F.upper("name")), ["_key"], F.asc("code")).select("_key", F.col("parent").alias("_parent"))
    plain = first_per_key(gazetteer.withColumn("_bare", bare(F.col("name"))), ["_bare"], F.asc("code")).select("_bare", F.col("parent").alias("_other"))
    name = normalized(F.col("raw_value"))
    missing = found.filter("member_id is null").select("raw_value", F.upper(name).alias("_key"), bare(name).alias("_bare"))
    known = missing.join(exact, "_key", "left").join(plain, "_bare", "left").withColumn("parent_id", F.coalesce("_parent", "_other")).filter("parent_id is not null")
    return _added(found, known.select("raw_value", member_id("city", name).alias("member_id"), name.alias("name"), "parent_id"), aliases)


def resolve_markets(places: DataFrame, members: DataFrame, aliases: DataFrame) -> Resolution:
    """Markets of ``places`` (place: 'City, Market'; city_id; city: the name of that city's member): by alias, else the city's own market, which is created.

    Here raw_value is the place; places without a city have no market.
    """
    named = places.select("place", "city_id", "city", split_at_last_comma(F.col("place"))["market"].alias("market")).distinct()
    known = aliases.groupBy("raw_value").agg(F.min("member_id").alias("_by"))
    exact = known.select(F.col("raw_value").alias("market"), F.col("_by").alias("_exact"))
    again = known.select(F.col("raw_value").alias("_name"), F.col("_by").alias("_again"))
    looked = named.withColumn("_name", normalized(F.col("market"))).join(exact, "market", "left").join(again, "_name", "left")
    own = F.concat(F.lit(OWN_MARKET), F.col("city"))
    owned = members.groupBy(F.col("name").alias("_own")).agg(F.min("member_id").alias("_owned"))
    looked = looked.withColumn("_own", own).join(owned, "_own", "left").withColumn("_made", F.when(F.col("city_id").isNotNull(), member_id("market", own)))
    chosen = F.coalesce("_exact", "_again", "_owned", "_made")
    how = F.when(F.coalesce("_exact", "_again").isNotNull(), "alias").when(F.col("_owned").isNotNull(), "own_market").when(F.col("_made").isNotNull(), "created").otherwise("none")
    found = looked.select(F.col("place").alias("raw_value"), chosen.alias("member_id"), how.alias("resolved_by"), "_own", "city_id")
    new = found.filter("resolved_by = 'created'").select("member_id", F.col("_own").alias("name"), F.col("city_id").alias("parent_id")).distinct()
    fresh = new.select(F.col("name").alias("raw_value"), "member_id").join(aliases.select("raw_value"), "raw_value", "left_anti")
    return Resolution(found.select("raw_value", "member_id", "resolved_by"), new, fresh)

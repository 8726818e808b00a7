"""Building and maintaining dimensions: distinct names, backfills, classification links and code-based merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosecha.functions.columns import first_per_key
from cosecha.functions.names import standard_forms
from cosecha.functions.text import collapse_spaces


def raw_values(rows: DataFrame, column: str, kind: Column) -> DataFrame:
    """(raw, rows, standardized, comparison_key): the distinct values of a column with their frequency and standard forms, most frequent first.

    ``kind`` (category, city, product or another word) tells which rules a value follows.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))
    forms = standard_forms(F.col("raw"), F.col("kind"))
    return counts.select("raw", "kind", "rows", *(forms[c].alias(c) for c in ("original", "standardized", "comparison_key"))).orderBy(F.desc("rows"), "raw")


def with_ids(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with a stable text id, the same for the same name in every run."""
    named = names.select(collapse_spaces(F.col(column)).alias("name")).filter("name != ''").distinct()
    return named.select(F.sha2("name", 256).alias("member_id"), "name")


def backfilled(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` whose missing ``column`` takes the value that ``found`` has for the key; known values stay."""
    other = found.select(key, F.col(column).alias("_found"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")


def linked_codes(members: DataFrame, prices: DataFrame, codes: DataFrame) -> DataFrame:
    """(member_id, code, linked_by, own_code): the classification's code of each member.

    It is the member's own code if the classification has it, else that of its newest price with a code, if the classification
    has that one; the smallest code on ties. An empty own code is filled with what was found.
    """
    known = codes.select(F.col("code").alias("_code")).distinct()
    own = members.join(known, F.col("code") == F.col("_code"), "left").select("member_id", F.nullif("code", F.lit("")).alias("own_code"), F.col("_code").alias("own"))
    coded = prices.filter("code is not null and code != ''")
    newest = first_per_key(coded, ["member_id"], F.desc("price_date"), F.asc("code")).join(known, F.col("code") == F.col("_code"), "left_semi")
    both = own.join(newest.select("member_id", F.col("code").alias("latest")), "member_id", "left")
    how = F.when(F.col("own").isNotNull(), "direct").when(F.col("latest").isNotNull(), "latest_price").otherwise("none")
    linked = F.coalesce("own", "latest")
    return both.select("member_id", linked.alias("code"), how.alias("linked_by"), F.coalesce("own_code", linked).alias("own_code"))


def merged_by_code(members: DataFrame, code: str = "code") -> DataFrame:
    """(loser, winner) of members that share an official code. ``members``: member_id, name, aliases, code.

    More aliases win, then a name with letters of both cases, then the smallest first letter, then the smallest id.
    """
    coded = members.filter(F.col(code).isNotNull() & (F.col(code) != ""))
    both_cases = F.col("name").rlike(r"\p{Ll}") & F.col("name").rlike(r"\p{Lu}")
    best = first_per_key(coded, [code], F.desc("aliases"), F.desc(both_cases), F.asc(F.ascii("name")), F.asc("member_id")).select(code, F.col("member_id").alias("winner"))
    return coded.join(best, code).filter("member_id != winner").select(F.col("member_id").alias("loser"), "winner")


def with_collision_suffix(names: DataFrame, name: str, parent: str) -> DataFrame:
    """``names`` with ``unique_name``: the name, and its parent in brackets where other parents have it too."""
    shared = names.groupBy(name).agg(F.countDistinct(parent).alias("_parents"))
    label = F.when(F.col("_parents") > 1, F.concat(name, F.lit(" ("), parent, F.lit(")"))).otherwise(F.col(name))
    return names.join(shared, name).withColumn("unique_name", label).drop("_parents")


def located(places: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """``places`` with coordinates, which count only if neither is zero."""
    both = (F.col("longitude") != 0) & (F.col("latitude") != 0)
    joined = places.join(gazetteer.select(key, "longitude", "latitude"), key, "left")
    return joined.withColumns({c: F.when(both, F.col(c)) for c in ("longitude", "latitude")})

"""Observations from staged rows: dimensions with aliases, the conforming joins, and what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosecha.functions.columns import first_per_key
from cosecha.functions.names import input_stem, normalized
from cosecha.functions.text import strip_accents
from cosecha.operators.conform import matching_ratio

# Cities that are headings, the name of an unknown department, and of a city's own market.
JUNK_CITIES = ["PRODUCTOS DE PRIMERA CALIDAD - BOLETIN GRATUITO"]
UNKNOWN = "Desconocido"
OWN_MARKET = "Mercado municipal de "


def aliased(rows: DataFrame, raw: str, merges: DataFrame | None = None, junk: list[str] = ()) -> DataFrame:
    """(raw_value, name) of the distinct values that are neither empty nor junk: by ``merges`` (raw_value, name), else normalised."""
    values = rows.select(F.col(raw).alias("raw_value")).filter("raw_value != ''").distinct()
    values = values.filter(~F.col("raw_value").isin(list(junk))) if junk else values
    if merges is None:
        return values.withColumn("name", normalized(F.col("raw_value")))
    chosen = merges.groupBy("raw_value").agg(F.min("name").alias("merged"))
    return values.join(chosen, "raw_value", "left").select("raw_value", F.coalesce("merged", normalized(F.col("raw_value"))).alias("name"))


def departments_of(cities: DataFrame, gazetteer: DataFrame, overrides: DataFrame) -> DataFrame:
    """(city, department, found_by) of ``cities`` (city): by override, by the gazetteer's name in capitals, by that without accents, else unknown.

    ``gazetteer`` and ``overrides``: municipality, department; of several the first by name.
    """
    plain = strip_accents(F.upper("municipality"))
    one = lambda rows, key, name: rows.groupBy(key.alias("_key")).agg(F.min("department").alias(name)).withColumnRenamed("_key", f"_{name}")
    out = cities.select("city").distinct()
    for rows, key, own, name in (
        (overrides, F.col("municipality"), F.col("city"), "override"),
        (gazetteer, F.upper("municipality"), F.upper("city"), "name"),
        (gazetteer, plain, strip_accents(F.upper("city")), "plain_name"),
    ):
        side = one(rows, key, name)
        out = out.join(side, own == side[f"_{name}"], "left").drop(f"_{name}")
    how = F.when(F.col("override").isNotNull(), "override").when(F.col("name").isNotNull(), "name").when(F.col("plain_name").isNotNull(), "plain_name").otherwise("none")
    return out.select("city", F.coalesce("override", "name", "plain_name", F.lit(UNKNOWN)).alias("department"), how.alias("found_by"))


def markets_of_cities(rows: DataFrame, cities: DataFrame, markets: DataFrame) -> DataFrame:
    """(city, market): each market under the city it stands with most often (by their names in ``cities`` and ``markets``), and each city's own market."""
    named = rows.filter("city != '' and market != ''").groupBy("city", "market").agg(F.count(F.lit(1)).alias("n"))
    named = named.join(cities.select(F.col("raw_value").alias("city"), F.col("name").alias("city_name")), "city").join(markets.select(F.col("raw_value").alias("market"), F.col("name").alias("market_name")), "market")
    counts = named.groupBy("city_name", "market_name").agg(F.sum("n").alias("n"))
    best = first_per_key(counts, ["market_name"], F.desc("n"), F.asc("city_name")).select(F.col("city_name").alias("city"), F.col("market_name").alias("market"))
    own = cities.select(F.col("name").alias("city")).distinct().select("city", F.concat(F.lit(OWN_MARKET), "city").alias("market"))
    return best.unionByName(own).distinct()


def taxonomy(rows: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subcategories (subcategory, category) and products (product, subcategory) of ``rows`` (category, subcategory, product), with ``categories`` (raw_value, name).

    A subcategory belongs to the category it stands with most often; each category also has
    a catch-all. A product belongs to the subcategory it stands with most often, a missing
    one counting as the catch-all. Products seen only under unknown categories are left out.
    """
    known = rows.join(categories.select(F.col("raw_value").alias("category"), F.col("name").alias("category_name")), "category")
    catch_all = lambda c: F.concat(F.lit("General ("), c, F.lit(")"))
    part = F.coalesce(normalized(F.nullif("subcategory", F.lit(""))), catch_all(F.col("category_name")))
    known = known.withColumns({"part": part, "name": normalized(F.col("product"))})
    counts = known.groupBy("category_name", "part", "name").agg(F.count(F.lit(1)).alias("n"))
    parents = counts.filter(~F.col("part").startswith("General (")).groupBy("part", "category_name").agg(F.sum("n").alias("n"))
    parts = first_per_key(parents, ["part"], F.desc("n"), F.asc("category_name")).select(F.col("part").alias("subcategory"), F.col("category_name").alias("category"))
    parts = parts.unionByName(categories.select(catch_all(F.col("name")).alias("subcategory"), F.col("name").alias("category")).distinct())
    per_product = counts.filter("name != ''").groupBy("name", "part").agg(F.sum("n").alias("n"))
    products = first_per_key(per_product, ["name"], F.desc("n"), F.asc("part")).select(F.col("name").alias("product"), F.col("part").alias("subcategory"))
    return parts, products


def observations(staged: DataFrame, products: DataFrame, cities: DataFrame, markets: DataFrame, presentations: DataFrame, units: DataFrame, own_markets: DataFrame) -> DataFrame:
    """``staged`` rows (id, product, city, market, presentation, units, ..) with the keys of all dimensions; rows whose product or city no alias knows go.

    ``products`` (raw_value, product_id, subcategory_id, category_id) and ``cities``
    (raw_value, city_id, department_id) must match; ``markets``, ``presentations`` and
    ``units`` (raw_value, id) may. An empty text matches no alias. A row without a market
    takes the city's own (``own_markets``: city_id, market_id; the smallest of several, so
    that no row is doubled). Each alias is taken once, so the result has at most one row a staged row.
    """
    once = lambda rows, *values: rows.groupBy("raw_value").agg(*(F.min(v).alias(v) for v in values))
    named = lambda rows, raw: rows.withColumnRenamed("raw_value", raw)
    out = staged.join(named(once(products, "product_id", "subcategory_id", "category_id"), "product"), "product")
    out = out.join(named(once(cities, "city_id", "department_id"), "city"), "city")
    for rows, raw, key in ((markets, "market", "market_id"), (presentations, "presentation", "presentation_id"), (units, "units", "units_id")):
        side = once(rows.select("raw_value", F.col("id").alias(key)), key)
        out = out.join(side, (F.col(raw) == side["raw_value"]) & (F.col(raw) != ""), "left").drop("raw_value")
    own = own_markets.groupBy("city_id").agg(F.min("market_id").alias("own_market"))
    return out.join(own, "city_id", "left").withColumn("market_id", F.coalesce("market_id", "own_market")).drop("own_market")


def monthly_totals(staged: DataFrame, kept: DataFrame, date: str) -> DataFrame:
    """By month: staged rows, those kept, and those skipped."""
    month = F.date_format(date, "yyyy-MM").alias("month")
    total = staged.groupBy(month).agg(F.count(F.lit(1)).alias("staged"))
    used = kept.groupBy(month).agg(F.count(F.lit(1)).alias("kept"))
    out = total.join(used, "month", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("skipped", F.col("staged") - F.col("kept"))


def alias_gaps(staged: DataFrame, aliases: dict[str, DataFrame]) -> DataFrame:
    """(field, raw_value, rows): for each field the values that no alias knows, empty ones as '', and a row of the total of rows that any field skips."""
    found, marked = [], staged
    for field, known in aliases.items():
        side = known.select(F.col("raw_value").alias(f"_{field}")).distinct()
        marked = marked.join(side, F.col(field) == F.col(f"_{field}"), "left")
        missing = marked.filter(F.col(f"_{field}").isNull()).groupBy(F.coalesce(field, F.lit("")).alias("raw_value")).agg(F.count(F.lit(1)).alias("rows"))
        found.append(missing.select(F.lit(field).alias("field"), "raw_value", "rows"))
    skipped = " or ".join(f"_{field} is null" for field in aliases)
    found.append(marked.filter(skipped).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("skipped").alias("field"), F.lit("").alias("raw_value"), "rows"))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def backfilled_codes(inputs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(input_id, code, found_by) for inputs without a code, from those of their subgroup: its only code, the most alike name's, else the commonest code.

    ``inputs``: input_id, name, subgroup, code. Subgroups without any code give nothing.
    Names are compared without sizes and formulations. Equal names and codes of a subgroup
    count once, so a comparison is made for each pair of different names of a subgroup.
    """
    coded, bare = inputs.filter("code is not null"), inputs.filter("code is null")
    counts = coded.groupBy("subgroup", "code").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("subgroup").agg(F.count(F.lit(1)).alias("codes"))
    mode = first_per_key(counts, ["subgroup"], F.desc("n"), F.asc("code")).select("subgroup", F.col("code").alias("mode"))
    bare = bare.join(mode.join(groups, "subgroup"), "subgroup").withColumn("_a", input_stem(F.col("name")))
    names = coded.groupBy("subgroup", input_stem(F.col("name")).alias("_b")).agg(F.min(F.struct("input_id", "code"))["code"].alias("near"))
    wanted = bare.filter("codes > 1").select("subgroup", "_a").distinct()
    pairs = wanted.join(names, "subgroup").withColumn("ratio", matching_ratio("_a", "_b")).filter(F.col("ratio") >= threshold)
    best = first_per_key(pairs, ["subgroup", "_a"], F.desc("ratio"), F.asc("_b")).select("subgroup", "_a", "near")
    out = bare.join(best, ["subgroup", "_a"], "left")
    how = F.when(F.col("codes") == 1, "single-code").when(F.col("near").isNotNull(), "name-match").otherwise("subgroup-mode")
    return out.select("input_id", F.when(F.col("codes") == 1, F.col("mode")).otherwise(F.coalesce("near", "mode")).alias("code"), how.alias("found_by"))


def gazetteer_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Departments (code, name) and municipalities (code, name, department_code) of gazetteer rows, one of each code."""
    departments = rows.groupBy(F.col("department_code").alias("code")).agg(F.min("department").alias("name"))
    places = rows.groupBy(F.col("municipality_code").alias("code")).agg(F.min_by(F.struct("municipality", "department_code"), F.struct("municipality", "department_code")).alias("m"))
    return departments.filter("code is not null"), places.filter("code is not null").select("code", F.col("m.municipality").alias("name"), "m.department_code")


def renamed(members: DataFrame, aliases: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (member_id, name) and aliases (raw_value, member_id) after ``names`` (old, new): the old name becomes an alias first, unless there is one."""
    one = names.groupBy("old").agg(F.min("new").alias("new"))
    both = members.join(one, members["name"] == one["old"], "left")
    old = both.filter("new is not null").select(F.col("name").alias("raw_value"), "member_id").join(aliases.select("raw_value"), "raw_value", "left_anti")
    return both.select("member_id", F.coalesce("new", "name").alias("name")), aliases.select("raw_value", "member_id").unionByName(old.select("raw_value", "member_id"))


def own_named(members: DataFrame, name: str, prefix: str = OWN_MARKET) -> DataFrame:
    """Members whose name begins with ``prefix``."""
    return members.filter(F.col(name).startswith(prefix))


def error_context(errors: DataFrame, downloads: DataFrame, documents: DataFrame, done: DataFrame, is_transient: Column) -> DataFrame:
    """Unresolved errors that are not transient and whose source has no rows, with the file and the document that they stand for, where known."""
    open_ = errors.filter(~F.col("resolved") & ~is_transient).join(done.select("source").distinct(), "source", "left_anti")
    return open_.join(downloads, "download_id", "left").join(documents, "document_id", "left")


def snapshot_groups(before: DataFrame, after: DataFrame, key: Column) -> DataFrame:
    """(norm_key, kind, old_members, new_members) of the keys that a member new in ``after`` shares with others: NEW+EXISTING or NEW+NEW. Both: member_id, name."""
    marked = after.join(before.select("member_id", F.lit(1).alias("_old")), "member_id", "left").withColumn("norm_key", key)
    groups = marked.groupBy("norm_key").agg(F.count("_old").alias("old_members"), F.count_if(F.col("_old").isNull()).alias("new_members"))
    kind = F.when(F.col("old_members") > 0, "NEW+EXISTING").otherwise("NEW+NEW")
    # Names without a key are no group.
    return groups.filter("norm_key != '' and new_members > 0 and old_members + new_members > 1").select("norm_key", kind.alias("kind"), "old_members", "new_members")


def retried(errors: DataFrame, succeeded: DataFrame, most: int = 3) -> DataFrame:
    """The dead letters after a run over ``errors`` (error_id, source, retry_count, resolved): those whose source ``succeeded`` are resolved, other open ones tried once more.

    ``queued`` says whether a row is to be tried again: open, and tried fewer than ``most`` times.
    """
    good = succeeded.select("source", F.lit(True).alias("_good")).distinct()
    both = errors.join(good, "source", "left").withColumn("_good", F.coalesce("_good", F.lit(False)))
    tried = F.col("retry_count") + F.when(~F.col("resolved"), 1).otherwise(0)
    done = F.col("resolved") | F.col("_good")
    out = both.withColumns({"retry_count": tried.cast("int"), "resolved": done}).drop("_good")
    return out.withColumn("queued", ~F.col("resolved") & (F.col("retry_count") < most))


def pending(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents of a ledger (document_id, status, date) that were not processed, oldest first, undated last."""
    rows = ledger.filter(~F.col("status")).orderBy(F.asc_nulls_last("date"), "document_id")
    return rows if limit is None else rows.limit(limit)


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, columns, rows) of each table."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(len(rows.columns)).cast("long").alias("columns"), "rows")
        out = one if out is None else out.unionByName(one)
    return out

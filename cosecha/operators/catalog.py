"""Catalogue lookups, farm inputs, hierarchies and comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.columns import exact_mean, first_per_key, optional, text, trailing


def search_products(products: DataFrame, search: str | None = None, category: str | None = None, subcategory: str | None = None, limit: int | None = 50) -> DataFrame:
    """Products by name; ``search`` is a substring whatever its case, in which % and _ are wild."""
    rows = optional(products, category_name=category, subcategory_name=subcategory)
    rows = rows.filter(F.col("product_name").ilike(f"%{search}%")) if search else rows
    return rows.orderBy("product_name", "product_id").limit(limit) if limit is not None else rows


def located_markets(markets: DataFrame, cities: DataFrame, departments: DataFrame) -> DataFrame:
    """Markets with city and department, and a label that adds the city unless the name has it."""
    rows = markets.join(cities, "city_id", "left").join(departments, "department_id", "left")
    contains = F.lower("market_name").contains(F.lower("city_name"))
    label = F.when(contains, F.col("market_name")).otherwise(F.concat("market_name", F.lit(" ("), "city_name", F.lit(")")))
    return rows.select("market_id", "market_name", "city_name", "department_name", label.alias("label"))


def latest_input_prices(inputs: DataFrame, departments: DataFrame, as_of: str, days: int = 180, wanted: Sequence[int] | None = None) -> DataFrame:
    """The newest price of each input, the first presentation on ties."""
    rows = inputs.filter(trailing("price_date", as_of, days)).join(departments, "department_id")
    rows = rows if wanted is None else rows.filter(F.col("input_id").isin(list(wanted)))
    order = [F.desc("price_date"), F.asc_nulls_last("presentation"), F.desc("order_id"), F.desc("line"), F.desc("avg_price")]
    newest = first_per_key(rows, ["input_id"], *order)
    return newest.select("input_id", "department_id", "department_name", text("price_date"), F.col("avg_price").cast("double").alias("avg_price"), "presentation")


def latest_by_code(inputs: DataFrame, departments: DataFrame, code: str) -> DataFrame:
    """The newest price of each department, brand, article and presentation under a classification code."""
    rows = inputs.filter(F.col("cpc_code") == code).join(departments, "department_id")
    order = [F.desc("price_date"), F.desc("order_id"), F.desc("line"), F.desc("avg_price")]
    newest = first_per_key(rows, ["department_id", "brand", "article", "presentation"], *order)
    return newest.select("department_name", "article", "brand", "presentation", F.col("avg_price").cast("double").alias("avg_price"), text("price_date"))


def latest_by_subgroup(inputs: DataFrame, departments: DataFrame, cities: DataFrame, subgroup: str) -> DataFrame:
    """The newest price of each input, department, city and presentation of a subgroup; a missing city has an empty name."""
    rows = inputs.filter(F.col("subgroup") == subgroup).join(departments, "department_id")
    order = [F.desc("price_date"), F.desc("order_id"), F.desc("line"), F.desc("avg_price")]
    newest = first_per_key(rows, ["input_id", "department_id", "city_id", "presentation"], *order)
    named = newest.join(cities.select("city_id", "city_name"), "city_id", "left")
    return named.select("department_name", "article", F.coalesce("city_name", F.lit("")).alias("brand"), "presentation", F.col("avg_price").cast("double").alias("avg_price"), text("price_date"))


def latest_codes(inputs: DataFrame) -> DataFrame:
    """The newest classification code of each input."""
    order = [F.desc("price_date"), F.asc("cpc_code"), F.desc("order_id")]
    return first_per_key(inputs.filter("cpc_code is not null"), ["input_id"], *order).select("input_id", "cpc_code")


def input_history(inputs: DataFrame, input_id: int) -> DataFrame:
    """Monthly mean of an input by department."""
    rows = optional(inputs, input_id=input_id)
    return rows.groupBy("department_id", "price_date").agg(exact_mean("avg_price").alias("mean_price")).select("department_id", text("price_date"), "mean_price")


def classification_tree(products: DataFrame) -> DataFrame:
    """Every node of type, brand and product with its ancestors and the products under it."""
    levels = products.groupBy("category_name", "subcategory_name", "product_id").agg(F.count(F.lit(1)).alias("n"))
    rolled = levels.rollup("category_name", "subcategory_name", "product_id").agg(F.sum("n").alias("products"), F.grouping_id().alias("g")).filter("g < 7")
    code = F.concat_ws("/", "category_name", "subcategory_name", F.col("product_id").cast("string"))
    parent = F.when(F.col("g") == 3, F.lit(None).cast("string")).when(F.col("g") == 1, F.col("category_name")).otherwise(F.concat_ws("/", "category_name", "subcategory_name"))
    level = F.when(F.col("g") == 3, "section").when(F.col("g") == 1, "group").otherwise("product")
    return rolled.select(code.alias("code"), parent.alias("parent"), level.alias("level"), "products")


def section_tree(products: DataFrame) -> DataFrame:
    """Categories with their subcategories and sizes, in order; unnamed ones are 'Otro' and 'General'."""
    named = products.select(F.coalesce("category_name", F.lit("Otro")).alias("category"), F.coalesce("subcategory_name", F.lit("General")).alias("subcategory"))
    sizes = named.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat_ws(":", "subcategory", F.col("n").cast("string"))
    return sizes.groupBy("category").agg(F.sum("n").alias("products"), F.concat_ws(",", F.sort_array(F.collect_list(part))).alias("subcategories"))


def entity_comments(conversations: DataFrame, products: DataFrame, markets: DataFrame) -> DataFrame:
    """Comments on products and markets with the name of what they are about: a typed lookup over both."""
    kind = F.when(F.col("conv_id") % 2 == 0, "product").otherwise("market")
    rows = conversations.select("conv_id", "turn", kind.alias("entity_type"), (F.col("conv_id") % 50 + 1).alias("entity_id"), F.trim("text").alias("content"))
    names = products.select(F.lit("product").alias("entity_type"), F.col("product_id").alias("entity_id"), F.col("product_name").alias("entity_name"))
    names = names.unionByName(markets.select(F.lit("market").alias("entity_type"), F.col("market_id").alias("entity_id"), F.col("market_name").alias("entity_name")))
    found = rows.join(names, ["entity_type", "entity_id"], "left")
    return found.select("conv_id", "turn", "entity_type", "entity_id", "entity_name", F.length("content").cast("long").alias("content_chars"))


def named_lists(products: DataFrame, departments: DataFrame, inputs: DataFrame) -> DataFrame:
    """(kind, name, parent) of all categories, subcategories, departments, input groups and input subgroups."""
    rows = None
    for kind, source, name, parent in (
        ("category", products, "category_name", None),
        ("subcategory", products, "subcategory_name", "category_name"),
        ("department", departments, "department_name", None),
        ("input_group", inputs, "subgroup", None),
        ("input_subgroup", inputs, "cpc_code", "subgroup"),
    ):
        above = F.col(parent) if parent else F.lit(None).cast("string")
        one = source.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), above.alias("parent")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows


def sections(rows: DataFrame, section: str, name: str, unnamed: str = "Otro") -> DataFrame:
    """Each section with its size and the names in it, in order."""
    named = rows.select(F.coalesce(section, F.lit(unnamed)).alias("section"), name)
    return named.groupBy("section").agg(F.count(F.lit(1)).alias("members"), F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("names"))


def input_tree(inputs: DataFrame) -> DataFrame:
    """Inputs by group, subgroup and code with their number; codes in order, none last."""
    parts = inputs.select(F.col("category_name").alias("input_group"), F.coalesce("subcategory_name", F.lit("General")).alias("subgroup"), "cpc_code")
    sizes = parts.groupBy("input_group", "subgroup", "cpc_code").agg(F.count(F.lit(1)).alias("members"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy("input_group", "subgroup").orderBy(F.asc_nulls_last("cpc_code"))))


def named_twice(rows: DataFrame, names: DataFrame, key: str, name: str, first: str, second: str) -> DataFrame:
    """``rows`` with from_name and to_name: one dimension joined by two keys; unknown ones are null."""
    side = lambda by, out: names.select(F.col(key).alias(by), F.col(name).alias(out))
    return rows.join(side(first, "from_name"), first, "left").join(side(second, "to_name"), second, "left")


def city_history(inputs: DataFrame) -> DataFrame:
    """Monthly mean of each input by city; rows without a city are left out."""
    rows = inputs.filter("city_id is not null")
    return rows.groupBy("input_id", "city_id", "price_date").agg(exact_mean("avg_price").alias("mean_price")).select("input_id", "city_id", text("price_date"), "mean_price")


def named_entities(rows: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """``rows`` (entity_type, entity_id, ..) with entity_name by a table of (id, name) for each type; an unknown one is null."""
    names = None
    for kind, table in kinds.items():
        key, name = table.columns
        one = table.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), F.col(name).alias("entity_name")).distinct()
        names = one if names is None else names.unionByName(one)
    return rows.join(names, ["entity_type", "entity_id"], "left")


def new_comments(comments: DataFrame) -> DataFrame:
    """Comments to insert, with outer blanks gone; empty ones are left out."""
    return comments.withColumn("content", F.trim("content")).filter("content != ''")

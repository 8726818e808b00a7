"""Daily price workbooks: one wide sheet a file, markets across, categories and products down."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.text import split_city_market
from cosecha.sources.workbooks import price_of, text_of, typed_cells

#: Rows among which the date stands, and rows from the date on among which the markets do.
DATE_ROWS, HEADER_ROWS = 10, 10
# What marks the row of markets, what a row of markets holds, and the row above one of prices.
_MARKS, _CITIES, _MAIN = ("Precio", "Bogot", "Medell"), ("Bogot", "Medell", "Cali", "Barranquilla", "Armenia"), ("Bogot", "Medell")
# What every date text holds.
_DATED = r"\s([dD][eE]|\d{1,2},?)\s+\d{4}"
# What every row of these workbooks is priced in.
PRESENTATION, UNITS = "Kilogramo", "1 Kilogramo"


def is_date_text(text: Column) -> Column:
    """Whether a text has a date in words, Spanish (also its unfilled form) or English, and is no formula."""
    word = r"[\p{L}\p{N}_]+"
    spanish = rf"(?i)(\d{{1,2}}|XX)\s+de\s+{word}\s+de\s+\d{{4}}"
    english = rf"{word}\s+\d{{1,2}},?\s+\d{{4}}"
    return text.rlike(f"{spanish}|{english}") & ~text.startswith("=") & ~F.upper(text).contains("TODAY()")


def _by_file():
    # A sheet has a bounded number of rows, so one file is a bounded group.
    return Window.partitionBy("file").orderBy("row")


def _markets(cells: Column) -> Column:
    """For each column of a row of markets its place, label, city and market."""
    label = lambda c: F.trim(F.regexp_replace(F.coalesce(c["text"], F.lit("")), "\n", " "))
    each = F.transform(cells, lambda c, k: F.struct(k.alias("at"), label(c).alias("label"), split_city_market(label(c)).alias("place")))
    return F.filter(each, lambda m: (m["at"] > 0) & ~m["label"].isin("", "Precio", "Var", "None") & ~m["label"].contains("%") & (m["place"]["city"] != ""))


def _headed(grid: DataFrame) -> DataFrame:
    """The rows of ``grid`` with header and markets of their file, in one pass: files are dealt and sorted once, and rows near the top are tested as one text."""
    whole = _by_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.col("row") < DATE_ROWS + HEADER_ROWS
    # No pattern spans two cells, as none matches the sign between them.
    rows = typed_cells(grid).withColumn("_text", F.when(top, F.array_join(F.col("cells.text"), "\x00")))
    dated = (F.col("row") <= DATE_ROWS) & F.col("_text").rlike(_DATED) & F.exists("cells", lambda c: F.coalesce(is_date_text(F.trim(c["text"])), F.lit(False)))
    some = lambda words: reduce(or_, (F.col("_text").contains(w) for w in words))
    rows = rows.withColumn("_is", F.when(top, F.struct("row", dated.alias("dated"), *(some(words).alias(n) for n, words in (("mark", _MARKS), ("city", _CITIES), ("main", _MAIN))))))
    rows = rows.drop("_text").withColumn("_tops", F.collect_list(F.when(F.col("_is.dated") | F.col("_is.mark"), F.col("_is"))).over(whole))
    first = lambda tops, test: F.get(F.filter(tops, test), F.lit(0))
    rows = rows.withColumn("_start", F.coalesce(first("_tops", lambda r: r["dated"])["row"], F.lit(1)))
    rows = rows.withColumn("_mark", first("_tops", lambda r: r["mark"] & (r["row"] >= F.col("_start")) & (r["row"] < F.col("_start") + HEADER_ROWS)))
    above = first("_tops", lambda r: (r["row"] == F.col("_mark.row") - 1) & r["main"])
    rows = rows.withColumn("_names", F.when(F.col("_mark.city"), F.col("_mark")).otherwise(F.coalesce(above, F.col("_mark")))).withColumn("header", F.col("_names.row"))
    rows = rows.withColumn("_named", F.when(top & (F.col("row") == F.col("header")) & (F.col("_is") == F.col("_names")), F.struct("cells", _markets(F.col("cells")).alias("markets"))))
    found = rows.withColumn("markets", F.min("_named").over(whole)["markets"])
    kind = found.schema["markets"].dataType
    return found.withColumn("markets", F.coalesce("markets", F.array().cast(kind))).drop("_is", "_tops", "_start", "_mark", "_names", "_named")


def daily_markets(grid: DataFrame) -> DataFrame:
    """(file, header, markets) of a ``grid`` (file, row from 1, cells): the row of the markets, and for each column its city and market.

    The row is sought from the row of the date on, or from the first; if it has no city itself, the row above it may be meant.
    Files without markets have an empty list.
    """
    top = _headed(grid).filter(F.col("row") < DATE_ROWS + HEADER_ROWS)
    return top.groupBy("file").agg(F.min("header").alias("header"), F.min("markets").alias("markets"))


def _marked(grid: DataFrame) -> DataFrame:
    """All rows with header and markets; those below the header with their first cell, their kind and the category above them, others without a first cell."""
    rows = _headed(grid)
    first = text_of(F.get("cells", F.lit(0)))
    below = F.col("file").isNotNull() & (F.col("row") >= F.col("header") + 2)
    rows = rows.withColumn("first", F.when(below, first))
    named = ~F.col("first").startswith("*") & ~F.col("first").startswith("n.d.") & ~F.col("first").contains("Var%")
    rows = rows.withColumn("first", F.when(named, F.col("first")))
    alone = F.col("first").isNotNull() & (F.array_join(F.slice("cells", 2, 4)["text"], "") == "")
    above = _by_file().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("alone", alone)
    return rows.withColumn("category", F.last(F.when(F.col("alone"), F.col("first")), ignorenulls=True).over(above))


def daily_prices(grid: DataFrame) -> DataFrame:
    """Prices of daily workbooks: file, row, category, product, presentation, units, round, city, market, min_price, max_price.

    Number cells count as they are, texts in the local form; empty cells, 'n.d.' and prices of 0 or less give none. A row
    whose second to fifth cells are empty names the category of those below; products above any category are problems.
    """
    rows = _marked(grid).filter("first is not null and not alone and category is not null and size(markets) > 0")
    priced = F.transform("markets", lambda m: F.struct(m["place"].alias("place"), price_of(F.get("cells", m["at"])).alias("price")))
    # Above an explode the test of a price does not work it out again.
    each = rows.select("file", "row", "category", F.col("first").alias("product"), F.explode(priced).alias("m")).filter("m.price is not null")
    return each.select(
        "file", "row", "category", "product", F.lit(PRESENTATION).alias("presentation"), F.lit(UNITS).alias("units"), F.lit(1).alias("round"),
        F.col("m.place.city").alias("city"), F.col("m.place.market").alias("market"), F.col("m.price").alias("min_price"), F.col("m.price").alias("max_price"),
    )


def daily_problems(grid: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Dead letters (file, row, error_type, error_message): no markets, a product above any category, prices without a date.

    ``dates`` (file, price_date) holds the dates that the links gave; without it every file counts as dated.
    All three are found in one pass over the rows.
    """
    file, rows = _by_file(), _marked(grid)
    product = F.col("first").isNotNull() & ~F.col("alone") & (F.size("markets") > 0)
    priced = product & F.col("category").isNotNull() & F.exists("markets", lambda m: price_of(F.get("cells", m["at"])).isNotNull())
    rows = rows.withColumns({"_nth": F.row_number().over(file), "_loose": product & F.col("category").isNull(), "_priced": priced if dates is not None else F.lit(False)})
    rows = rows.withColumn("_priced", F.max("_priced").over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    letter = lambda row, kind, message: F.struct(row.alias("row"), F.lit(kind).alias("error_type"), message.alias("error_message"))
    nothing, once = F.lit(None).cast(grid.schema["row"].dataType), F.col("_nth") == 1
    letters = F.array(
        F.when(once & ((F.size("markets") == 0) | F.col("file").isNull()), letter(nothing, "invalid_city_headers", F.lit("Could not find or parse city headers"))),
        F.when(F.col("_loose"), letter(F.col("row"), "missing_category", F.concat(F.lit("Product '"), F.col("first"), F.lit("' has no category")))),
        F.when(once & F.col("_priced"), letter(nothing, "missing_date", F.lit("No date available for Excel (row_date not provided)"))),
    )
    found = rows.select("file", F.explode(letters).alias("p")).filter("p is not null").select("file", "p.*")
    if dates is None:
        return found
    known = dates.filter("price_date is not null").select("file").distinct().withColumn("_dated", F.lit(True))
    return found.join(known, "file", "left").filter("_dated is null or error_type != 'missing_date'").drop("_dated")

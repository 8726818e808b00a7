"""Layouts of published workbooks and documents: rows of cells (file, row, cells), typed or plain text, to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.names import title_case
from cosecha.functions.text import classification_code, month_number, once, parse_price, parse_spanish_date
from cosecha.sources.workbooks import date_of, number_of, price_of, text_of, typed_cells


def cell(k: int) -> Column:
    """The k-th typed cell (from 0) as text without outer blanks; null if it is missing or empty."""
    return text_of(F.get("cells", F.lit(k)))


def _date(k: int) -> Column:
    return date_of(F.get("cells", F.lit(k)))


def _price(k: int) -> Column:
    return price_of(F.get("cells", F.lit(k)))


def _number(k: int) -> Column:
    return number_of(F.get("cells", F.lit(k)))



def _month_start(year: Column, month: Column) -> Column:
    number = once(month, lambda m: F.coalesce(month_number(m), m.try_cast("int")))
    date = lambda n: F.when(n.between(1, 12) & year.rlike(r"^\d{4}$"), F.make_date(year.try_cast("int"), n, F.lit(1)))
    return once(number, date)


def _built(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """file, row and ``columns``; above an explode a later test of a column does not work it out again."""
    one = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return rows.select("file", "row", F.explode(one).alias("_r")).select("file", "row", "_r.*")


def milk_prices(grid: DataFrame) -> DataFrame:
    """Milk prices of three layouts, told apart row by row: year and month, full date, or monthly ranges dated by the file's title.

    Dates are date cells, or texts that begin with one. Municipalities of the oldest layout get their capitals anew.
    """
    grid = typed_cells(grid)
    words = F.concat_ws(" ", F.transform("cells", lambda c: c["text"]))
    month = F.regexp_extract(words, r"(?i)(\p{L}++\s+de\s+\d{4})", 1)
    titled = once(month, lambda m: F.when(m != "", parse_spanish_date(F.concat(F.lit("1 de "), m))))
    rows = grid.withColumn("_title", F.max(titled).over(Window.partitionBy("file")))
    none = F.lit(None).cast("double")

    def priced(of: DataFrame, date: Column, department: int, municipality: Column, low: Column, high: Column, mean: int) -> DataFrame:
        columns = {"price_date": date, "department": cell(department), "municipality": municipality, "min_price": low, "max_price": high, "avg_price": _price(mean)}
        return _built(of, columns)

    dated = F.get("cells", F.lit(0))["kind"] == "date"
    by_month = rows.filter(cell(0).rlike(r"^(19|20)\d{2}$"))
    by_date = rows.filter(dated | cell(0).rlike(r"^\d{4}-\d{2}-\d{2}"))
    ranges = rows.filter(~dated & cell(0).rlike(r"^\d{1,2}$") & cell(2).rlike(r"^\d{4,5}$"))
    found = priced(by_month, _month_start(cell(0), cell(1)), 2, title_case(cell(4)), none, none, 6)
    found = found.unionByName(priced(by_date, _date(0), 1, cell(3), none, none, 5))
    found = found.unionByName(priced(ranges, F.col("_title"), 1, cell(3), _price(4), _price(5), 6))
    return found.filter(F.coalesce("avg_price", "min_price", "max_price").isNotNull() & F.col("price_date").isNotNull())


def rice_prices(grid: DataFrame) -> DataFrame:
    """Rice prices of the old layout (year and month) and the new one (full date, as a date cell or as text)."""
    grid = typed_cells(grid)

    def priced(of: DataFrame, date: Column, product: int, municipality: int, department: int, mean: int) -> DataFrame:
        columns = {"price_date": date, "product": cell(product), "municipality": cell(municipality), "department": cell(department), "avg_price": _price(mean)}
        return of.select("file", "row", *(c.alias(n) for n, c in columns.items()))

    dated = (F.get("cells", F.lit(0))["kind"] == "date") | cell(0).rlike(r"^\d{4}-\d{2}-\d{2}")
    old = priced(grid.filter(cell(0).rlike(r"^(19|20)\d{2}$")), _month_start(cell(0), cell(1)), 2, 4, 6, 7)
    return old.unionByName(priced(grid.filter(dated), _date(0), 1, 3, 5, 6)).filter("price_date is not null and avg_price is not null")


def supply_rows(grid: DataFrame) -> DataFrame:
    """Arrivals of the layout without and with a classification code, told apart by the number of cells."""
    grid = typed_cells(grid)
    coded = F.size("cells") >= 10
    quoted = lambda k: F.coalesce(classification_code(cell(k)), F.lit(""))
    named = {"city_market": cell(0), "observation_date": _date(1), "department_code": quoted(2), "municipality_code": quoted(3)}
    named |= {"department": cell(4), "municipality": cell(5), "food_group": cell(6), "cpc_code": F.when(coded, classification_code(cell(7)))}
    named |= {"product": F.when(coded, cell(8)).otherwise(cell(7)), "quantity_kg": F.when(coded, _number(9)).otherwise(_number(8))}
    rows = grid.select("file", "row", *(c.alias(n) for n, c in named.items()))
    return rows.filter("city_market is not null and observation_date is not null and product is not null and quantity_kg is not null")


def input_prices(grid: DataFrame) -> DataFrame:
    """Input prices of municipalities: year, month name, department, municipality, product, presentation if there is one, price."""
    grid = typed_cells(grid)
    wide = F.size("cells") >= 9
    named = {"price_date": _month_start(cell(0), cell(1)), "department_code": cell(2), "municipality_code": cell(4), "product": cell(6)}
    named |= {"presentation": F.when(wide, cell(7)), "avg_price": F.when(wide, _price(8)).otherwise(_price(7))}
    rows = _built(grid.filter(cell(0).rlike(r"^(19|20)\d{2}$")), named)
    return rows.filter("price_date is not null and product is not null and avg_price is not null")


def department_input_prices(grid: DataFrame) -> DataFrame:
    """Input prices of departments: year, month name, department code and name, classification code, product, article, brand, registration, presentation, price."""
    grid = typed_cells(grid)
    price = F.coalesce(_number(10), F.regexp_replace(cell(10), ",", ".").try_cast("double"))
    texts = ("department_code", "department", "cpc_code", "product", "article", "brand", "registration", "presentation")
    named = {"price_date": _month_start(cell(0), cell(1)), **{n: cell(k) for k, n in enumerate(texts, 2)}, "avg_price": price}
    rows = _built(grid.filter(cell(0).rlike(r"^(19|20)\d{2}$")), named)
    return rows.filter("price_date is not null and product is not null and avg_price is not null")


def sheet_index(grid: DataFrame) -> DataFrame:
    """(file, sheet, input_group, subgroup) of an index sheet (file, row, cells): a number such as '1.' and a group, then numbers such as '1.1' and the names of its sheets."""
    grid = typed_cells(grid)
    group = F.when(cell(0).rlike(r"^\d+\.$"), cell(1))
    filled = F.last(group, ignorenulls=True).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.withColumn("input_group", F.coalesce(filled, F.lit(""))).filter(cell(1).rlike(r"^\d+\.\d+$") & cell(2).isNotNull())
    named = rows.select("file", cell(1).alias("sheet"), "input_group", cell(2).alias("subgroup"), "row")
    # A sheet that stands twice has its last names.
    return named.groupBy("file", "sheet").agg(F.max_by(F.struct("input_group", "subgroup"), "row").alias("g")).select("file", "sheet", "g.*")


def with_groups(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (file, sheet, ..) with input_group and subgroup by ``index``; unknown sheets have the group 'Unknown' and their own number."""
    joined = rows.join(index, ["file", "sheet"], "left")
    return joined.withColumns({"input_group": F.coalesce("input_group", F.lit("Unknown")), "subgroup": F.coalesce("subgroup", "sheet")})


def data_sheets(grid: DataFrame) -> DataFrame:
    """Rows of the sheets whose name is a number such as '1.2'."""
    return grid.filter(F.col("sheet").rlike(r"^\d+\.\d+$"))


def food_codes(grid: DataFrame) -> DataFrame:
    """(product, cpc_code) of a correlation sheet (row from 1, cells): food in the third and code in the fourth column from row 10 on, the last of several."""
    rows = typed_cells(grid).filter((F.col("row") >= 10) & (F.size("cells") >= 5)).select(cell(2).alias("product"), cell(3).alias("cpc_code"), "row")
    return rows.filter("product is not null and cpc_code is not null").groupBy("product").agg(F.max_by("cpc_code", "row").alias("cpc_code"))


def with_food_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Supply ``rows`` whose missing classification code is that of their food."""
    found = codes.select("product", F.col("cpc_code").alias("_code"))
    return rows.join(found, "product", "left").withColumn("cpc_code", F.coalesce("cpc_code", "_code")).drop("_code")


def classification(rows: DataFrame) -> DataFrame:
    """Codes of one to five digits and longer products with level and ancestors, each a prefix of the code. ``rows``: code, title."""
    code = classification_code(F.col("code"))
    size = F.length(code)
    level = F.when(size == 1, "section").when(size == 2, "division").when(size == 3, "group").when(size == 4, "class").when(size == 5, "subclass").otherwise("product")
    prefix = lambda n: F.when(size > n, F.left(code, F.lit(n)))
    parent = F.when(size > 5, F.left(code, F.lit(5))).when(size > 1, F.left(code, size - 1))
    out = rows.select(code.alias("code"), F.trim("title").alias("title"), level.alias("level"), parent.alias("parent_code"), prefix(1).alias("section_code"), prefix(2).alias("division_code"), prefix(3).alias("group_code"), prefix(4).alias("class_code"))
    return out.filter("code is not null").dropDuplicates(["code"])


def recognised_prices(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Price rows of a recogniser's JSON list, with English or Spanish keys; a payload that is no list gives none."""
    keys = {"product": ("product", "producto"), "presentation": ("presentation", "presentacion"), "units": ("units", "unidades"), "min_price": ("min_price", "precio_minimo"), "max_price": ("max_price", "precio_maximo")}
    fields = ", ".join(f"{k} string" for pair in keys.values() for k in pair)
    each = payloads.select("file", F.explode(F.from_json(column, f"array<struct<{fields}>>")).alias("r"))
    value = lambda pair: F.coalesce(*(F.nullif(F.trim(F.col(f"r.{k}")), F.lit("")) for k in pair))
    out = each.select("file", *((parse_price(value(p)) if "price" in n else value(p)).alias(n) for n, p in keys.items()))
    return out.filter("product is not null and coalesce(min_price, max_price) is not null")


def document_name(name: Column) -> Column:
    """(city, market, date) of a file name such as 'Cali, Cavasa-5-3-2014.pdf'; the first comma splits."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"(?i)\.pdf$", "")
    pattern = r"^(.*?)-(\d{1,2})-(\d{1,2})-(\d{4})$"
    part = lambda k: F.regexp_extract(stem, pattern, k)
    place = F.when(part(4) != "", part(1)).otherwise(stem)
    joined = F.concat(part(4), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"))
    market = F.when(place.contains(","), F.trim(F.regexp_replace(place, r"^[^,]*,", "")))
    date = F.when(part(4) != "", F.try_to_timestamp(joined, F.lit("yyyy-MM-dd")).cast("date"))
    return F.struct(F.trim(F.substring_index(place, ",", 1)).alias("city"), market.alias("market"), date.alias("date"))

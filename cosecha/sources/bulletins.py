"""Price bulletins: what a document is, where and when it is from, and its table rows with category and subcategory."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.functions.text import collapse_spaces, once, parse_price, parse_spanish_date, split_city_market

# Headings of bulletins, in the spellings that occur; capitals throughout count too.
CATEGORIES = [
    "Frutas", "Verduras y hortalizas", "Verduras y Hortalizas", "Tuberculos, raices y platanos", "Tubérculos, raíces y plátanos", "Tubérculos y plátanos",
    "Procesados", "Carnes", "Granos y cereales", "Pescados", "Lacteos y huevos", "Lácteos y huevos",
]
CAPITAL_CATEGORIES = ["FRUTAS", "VERDURAS Y HORTALIZAS", "TUBERCULOS, RAICES Y PLATANOS", "PROCESADOS", "CARNES", "GRANOS Y CEREALES", "PESCADOS", "LACTEOS Y HUEVOS"]
SUBCATEGORIES = [
    "Cítricos", "CÍtricos", "Citricos", "Otras frutas", "Otros tubérculos", "Otros tuberculos", "Plátano", "PlÁtano", "Platano", "Papa", "Yuca", "Leguminosas",
    "Otras hortalizas y verduras", "Zanahorias", "Cebollas", "Tomates", "Hortalizas", "Carne de res", "Carne de cerdo", "Pollo", "Frescos y congelados", "Granos",
    "Cereales", "Otros procesados", "Aceites y grasas", "Panela", "Azúcar", "AzÚcar", "Azucar", "Lácteos", "LÁcteos", "Lacteos", "Huevos",
]
CAPITAL_SUBCATEGORIES = [
    "CITRICOS", "OTRAS FRUTAS", "OTROS TUBERCULOS", "PLATANO", "PAPA", "YUCA", "LEGUMINOSAS", "OTRAS HORTALIZAS Y VERDURAS", "ZANAHORIAS", "CEBOLLAS", "TOMATES",
    "HORTALIZAS", "CARNE DE RES", "CARNE DE CERDO", "POLLO", "FRESCOS Y CONGELADOS", "GRANOS", "CEREALES", "OTROS PROCESADOS", "ACEITES Y GRASAS", "PANELA", "AZUCAR",
    "LACTEOS", "HUEVOS",
]
# Words of heading rows, of rows below them, and of lines that are no place.
HEADING_WORDS = ["PRECIOS", "PRODUCTO", "PAGINA", "RONDA", "PRESENTACIÓN", "PRESENTACION"]
SUBHEADING_WORDS = ["MÍNIMO", "MÁXIMO", "MINIMO", "MAXIMO", "HORA INICIO", "HORA FINAL"]
NO_PLACE_WORDS = ["PRODUCTO", "PRIMERA CALIDAD", "BOLETIN", "BOLETÍN", "SISTEMA DE INFORMACI", "SIPSA", "RONDA", "MÍNIMO", "MÁXIMO"]
# Words of arrival tables, days in their headings, and words of news bulletins.
ARRIVAL_WORDS = ["mercado mayorista", "mercados mayoristas", "abastecimiento", "toneladas"]
DAY_WORDS = ["lunes", "martes", "miércoles", "miercoles", "jueves", "viernes", "sábado", "sabado", "domingo", "variación", "variacion"]
NEWS_WORDS = ["BOLETÍN DIARIO", "BOLETIN DIARIO", "PRECIOS MAYORISTAS", "SIPSA"]
TITLE = "PRECIOS DE VENTA MAYORISTA"
_DATE = r"(?i)\d{1,2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4}"


def _any(text: Column, words: list[str]) -> Column:
    return once(text, lambda t: reduce(or_, (t.contains(w) for w in words)))


def has_price(cells: Column, start: int = 3) -> Column:
    """Whether a cell from place ``start`` on is digits above 0 once dots and commas are gone."""
    rest = F.slice(cells, start + 1, F.greatest(F.size(cells) - start, F.lit(0)))
    digits = lambda c: F.regexp_replace(F.trim(c), "[.,]", "")
    return F.coalesce(F.exists(rest, lambda c: F.coalesce(digits(c).rlike("^[0-9]*[1-9][0-9]*$"), F.lit(False))), F.lit(False))


def is_heading(cells: Column) -> Column:
    """Whether the first cell has a word of heading rows, or any cell one of the rows below them."""
    first = F.upper(F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))))
    return _any(first, HEADING_WORDS) | _any(F.upper(F.array_join(cells, " ")), SUBHEADING_WORDS)


def is_arrival_table(rows: DataFrame) -> DataFrame:
    """(file, arrivals): whether the first five rows (file, row from 0, cells) of a table show that it lists arrivals, not prices."""
    text = F.lower(F.array_join("cells", " "))
    days = F.size(F.filter(F.array(*map(F.lit, DAY_WORDS)), lambda w: text.contains(w)))
    dates = lambda pattern: F.size(F.filter("cells", lambda c: F.trim(c).rlike(pattern)))
    shows = _any(text, ARRIVAL_WORDS) | (days >= 2) | (dates(r"^\d{2}/\d{2}/\d{4}") >= 2) | (dates(r"^\d{1,2}-[\p{L}\p{N}_]{3}\.?$") >= 2)
    return rows.groupBy("file").agg(F.coalesce(F.bool_or(shows & (F.col("row") < 5)), F.lit(False)).alias("arrivals"))


def is_news(text: Column) -> Column:
    """Whether a document is a news bulletin: it has a word of such and not the title of price tables."""
    return ~F.upper(text).contains(TITLE) & _any(F.upper(text), NEWS_WORDS)


def document_header(text: Column) -> Column:
    """(city, market, date) from a document's first 15 lines: the place is the first line that can be one among the four after the title, the date the last one given."""
    lines = F.slice(F.split(text, "\n"), 1, 19)
    titled = lambda line: F.upper(line).contains(TITLE)
    place = lambda line: (F.trim(line) != "") & ~_any(F.upper(line), NO_PLACE_WORDS) & ~line.rlike(_DATE)
    head = F.slice(lines, 1, 15)
    found = F.transform(head, lambda line, i: F.when(titled(line), F.get(F.filter(F.slice(lines, i + 2, 4), place), F.lit(0))))
    where = split_city_market(F.get(F.reverse(F.filter(found, lambda x: x.isNotNull())), F.lit(0)))
    dated = lambda line: ~titled(line) & F.lower(line).rlike("de 20|de diciembre|de enero") & line.rlike(_DATE)
    date = parse_spanish_date(F.get(F.reverse(F.filter(head, dated)), F.lit(0)))
    return F.struct(F.coalesce(where["city"], F.lit("")).alias("city"), F.coalesce(where["market"], F.lit("")).alias("market"), date.alias("date"))


def headed_rows(grid: DataFrame) -> DataFrame:
    """Product rows of ``grid`` (file, row, cells) with category and subcategory (null before the first category).

    Rows without a price are headings, and those just before a product row decide: of two
    or more the last two are category and subcategory, if the former is a known category;
    else the last one is the category, if known. A single one is a category, or, once
    there is a category, a subcategory, if known. Anything else changes nothing.
    """
    name = collapse_spaces(F.trim(F.get("cells", F.lit(0))))
    rows = grid.filter((F.coalesce(name, F.lit("")) != "") & ~is_heading(F.col("cells")))
    rows = rows.withColumns({"name": name, "priced": has_price(F.col("cells"))})
    order = Window.partitionBy("file").orderBy("row")
    above = lambda k: F.lag(F.when(~F.col("priced"), F.col("name")), k).over(order)
    rows = rows.withColumns({"one": above(1), "two": above(2)})
    category = lambda c: F.coalesce(F.col(c).isin(CATEGORIES + CAPITAL_CATEGORIES), F.lit(False))
    part = lambda c: F.coalesce(F.col(c).isin(SUBCATEGORIES + CAPITAL_SUBCATEGORIES), F.lit(False))
    pair = F.col("one").isNotNull() & F.col("two").isNotNull()
    new = F.when(F.col("priced") & pair & category("two"), F.col("two")).when(F.col("priced") & category("one"), F.col("one"))
    filled = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("new", new).withColumn("category", filled("new"))
    alone = F.col("priced") & F.col("one").isNotNull() & ~pair & part("one") & F.col("category").isNotNull() & F.col("new").isNull()
    below = F.when(F.col("new").isNotNull() & pair & category("two") & part("one"), F.col("one")).when(F.col("new").isNotNull(), "").when(alone, F.col("one"))
    rows = rows.withColumn("below", below).withColumn("subcategory", filled("below")).filter("priced")
    return rows.select("file", "row", "cells", "category", F.when(F.col("category").isNotNull(), F.coalesce("subcategory", F.lit(""))).alias("subcategory"))


def bulletin_prices(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price rows of at most two rounds, and the dead letters: product rows without a category. A second round needs both bounds."""
    rows = headed_rows(grid)
    cell = lambda k: collapse_spaces(F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit(""))))
    price = lambda k: parse_price(F.get("cells", F.lit(k)))
    bounds = lambda k, size: F.struct(F.lit(k).alias("round"), *(F.when(F.size("cells") >= size, price(2 * k + 1 + i)).alias(n) for i, n in enumerate(("min_price", "max_price"))))
    each = rows.filter("category is not null").withColumn("r", F.explode(F.array(bounds(1, 5), bounds(2, 7))))
    each = each.select("file", "row", "category", "subcategory", cell(0).alias("product"), cell(1).alias("presentation"), cell(2).alias("units"), "r.*")
    good = each.filter(((F.col("round") == 1) & F.coalesce("min_price", "max_price").isNotNull()) | F.col("min_price").isNotNull() & F.col("max_price").isNotNull())
    bad = rows.filter("category is null").select("file", "row", F.lit("missing_category").alias("error_type"), F.concat(F.lit("no category: "), cell(0)).alias("error_message"))
    return good, bad

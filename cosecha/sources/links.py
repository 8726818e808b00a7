"""Links of source pages: extraction, dates, kinds and freshness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cosecha.functions.text import MONTHS, calendar_date, dated_text, named_month, short_month


_ANCHORS = "place int, href string, text string, label string, cell int, cells int, first string"


class _Page(HTMLParser):
    """The anchors of a page in order, each with the place of its table cell in its row, and that row's first cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self._anchor: dict | None = None
        self._pieces: list[str] = []
        # Rows that are open, the innermost last: texts of their cells, and what waits for the row's end.
        self._rows: list[tuple[list[list[str]], list[dict]]] = []
        # Whether a cell of each open row is open, and how many rows were open where each open table began.
        self._inside: list[bool] = []
        self._tables: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self._tables.append(len(self._rows))
        elif tag == "tr":
            # A row that was left open ends where the next of its table begins.
            self._end_rows()
            self._rows.append(([], []))
            self._inside.append(False)
        elif tag in ("td", "th") and self._rows:
            self._rows[-1][0].append([])
            self._inside[-1] = True
        elif tag == "a":
            self._end_anchor()
            href = dict(attrs).get("href")
            if href is not None:
                row = self._rows[-1] if self._rows and self._inside[-1] else None
                self._anchor = {"href": href, "cell": len(row[0]) - 1 if row else None, "cells": None, "first": None}
                if row:
                    row[1].append(self._anchor)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end_anchor()
        elif tag in ("td", "th") and self._rows:
            self._inside[-1] = False
        elif tag == "tr":
            self._end_rows()
        elif tag == "table":
            self._end_rows()
            del self._tables[-1:]

    def handle_data(self, data: str) -> None:
        if self._anchor is not None:
            self._pieces.append(data)
        for texts, _ in self._rows:
            if texts:
                texts[-1].append(data)

    def _end_anchor(self) -> None:
        if self._anchor is not None:
            whole = "".join(self._pieces)
            self.found.append(self._anchor | {"text": whole.strip(" "), "label": _strings(self._pieces), "of": self._anchor})
            self._anchor, self._pieces = None, []

    def _end_rows(self) -> None:
        """End the open rows of the innermost table."""
        while len(self._rows) > (self._tables[-1] if self._tables else 0):
            texts, anchors = self._rows.pop()
            self._inside.pop()
            for anchor in anchors:
                anchor.update(cells=len(texts), first=_strings(texts[0]) if texts else None)

    def anchors(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._end_anchor()
        self._tables = []
        self._end_rows()
        return [f | {"cells": f["of"]["cells"], "first": f["of"]["first"]} for f in self.found]


def _strings(pieces: list[str]) -> str:
    """Texts without blanks at their ends, one after another."""
    return "".join(p.strip() for p in pieces)


def page_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each anchor with an address: page_id, place from 0, href, text and label (each piece of text without outer blanks).

    Inside tables also the cell's place in its row, how many cells the row has and the text of its first. Attributes may be quoted
    in any way, entities are resolved, comments and scripts are no part of a page; pages are read whole, one at a time.
    """
    names = [f.name for f in StructType.fromDDL(_ANCHORS)]
    schema = StructType([pages.schema["page_id"], *StructType.fromDDL(_ANCHORS)])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in enumerate(batch.column(1)):
                found = _Page().anchors(page.as_py() or "")
                if found:
                    columns = [pa.array([x if n == "place" else f[n] for x, f in enumerate(found)], arrow.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(found))), *columns], names=["page_id", *names])

    return pages.select("page_id", html).mapInArrow(read, schema)


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each anchor with an address: page_id, place from 0, href and text (tags and outer blanks gone)."""
    return page_anchors(pages, html).select("page_id", "place", "href", "text")


def absolute(base: Column, href: Column) -> Column:
    """``href`` on the site of ``base``, or as it is if it names one."""
    site = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(site, F.lit("/"), href))


def url_date(url: Column) -> Column:
    """The date in a file's address; the first of these forms that fits and is a date: 24dic2025, mayoristas_noviembre_30_2018,
    anex_feb_28_2022 or bol_feb_28_2022, mayoristas_anexo_sept_28_2012, mayoristas_anexo_agosto_31_2012, bol-reg-28-02-2022, sipsa-08-01-2021."""
    text = F.lower(url)
    number = lambda m: m.try_cast("int")
    forms = [
        (r"(\d{1,2})([a-z]{3,4})(\d{4})", (3, 2, 1), short_month),
        (r"mayoristas_([a-z]+)_(\d{1,2})_(\d{4})", (3, 1, 2), named_month),
        (r"(?:anex|bol)_([a-z]{3,4})_(\d{1,2})_(\d{4})", (3, 1, 2), short_month),
        (r"mayoristas_anexo_([a-z]{3,4})_(\d{1,2})_(\d{4})", (3, 1, 2), short_month),
        (r"mayoristas_anexo_([a-z]+)_(\d{1,2})_(\d{4})", (3, 1, 2), named_month),
        (r"bol-reg-(\d{1,2})-(\d{2})-(\d{4})", (3, 2, 1), number),
        (r"sipsa-(\d{1,2})-(\d{2})-(\d{4})", (3, 2, 1), number),
    ]

    def date(pattern: str, places: tuple[int, int, int], month: Callable[[Column], Column]) -> Column:
        year, name, day = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in places)
        return calendar_date(year, month(name), day)

    return F.coalesce(*(date(*form) for form in forms))


def milk_file_date(name: Column) -> Column:
    """The first of a month ('ene2026.xlsx'), else of a year ('2013-2019.xlsx'), at the end of a file's name."""
    year = F.nullif(F.regexp_extract(name, r"(\d{4})\.xlsx$", 1), F.lit(""))
    month = short_month(F.nullif(F.regexp_extract(F.lower(name), r"([a-z]{3,4})\d{4}\.xlsx$", 1), F.lit("")))
    return calendar_date(year, F.coalesce(month, F.lit(1)), F.lit(1))


def file_kind(url: Column, label: Column | None = None) -> Column:
    """zip, pdf or excel by the address's end, else by words of the address and the label; null for anything else."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    kind = F.when(path.endswith(".zip"), "zip").when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.xlsx?$"), "excel")
    text = F.lower(F.coalesce(label, F.lit(""))) if label is not None else F.lit("")
    return kind.when(text.contains("informes por ciudades") | path.contains("regionales"), "zip").when(text.contains("anexo") | path.contains("anex-"), "excel")


def link_kind(url: Column, label: Column) -> Column:
    """informes_ciudades before boletin before anexo, from address and label; null for anything else."""
    href, text = F.lower(url), F.lower(F.coalesce(label, F.lit("")))
    cities = text.contains("informes por ciudades") | href.contains("regionales")
    bulletin = text.contains("boletín") | text.contains("boletin") | href.contains("bol_") | href.contains("bol-") | (href.contains("mayoristas") & href.endswith(".pdf"))
    annex = text.contains("anexo") | href.contains("anex-") | href.contains("mayoristas")
    return F.when(cities, "informes_ciudades").when(bulletin, "boletin").when(annex, "anexo")


def page_layout(target: Column) -> Column:
    """The layout of a page by the date that it is for; 'current' without one."""
    from_ = lambda day: target >= F.lit(day).cast("date")
    return F.when(target.isNull(), "current").when(from_("2020-03-01"), "four_column").when(from_("2015-12-01"), "three_column").when(from_("2012-08-01"), "bullet_list").otherwise("simple_links")


def page_files(pages: DataFrame) -> DataFrame:
    """File links of ``pages`` (page_id, url, html, target: date or null) by their layout: page_id, href, text, kind, category, date.

    Current pages are tables of four columns: the third holds annexes and the fourth reports of cities; with three columns the
    last holds annexes. The row's first cell has the date, with the target's year or the page address's. Lists: labels 'Anexo - 31 de
    agosto', the year from the page's address. Simple links: the label is the date. A date that no text gives comes from
    the file's address. A page whose layout gives no link has all its file links, by their addresses alone.
    """
    year = F.nullif(F.regexp_extract("url", r"(\d{4})", 1), F.lit("")).try_cast("int")
    base = pages.select("page_id", page_layout(F.col("target")).alias("layout"), year.alias("page_year"), F.coalesce(F.year("target"), year).alias("year"))
    links = page_anchors(pages).filter(F.col("href").contains("/files/")).join(base, "page_id").withColumn("text", F.col("label"))
    layout, text, href = F.col("layout"), F.col("text"), F.col("href")
    four, three = layout.isin("four_column", "current") & F.col("cell").isin(2, 3), (layout == "three_column") & (F.col("cells") >= 3) & (F.col("cell") == F.col("cells") - 1)
    listed = (layout == "bullet_list") & F.lower(text).startswith("anexo")
    simple = (layout == "simple_links") & F.lower(href).rlike("mayoristas|sipsa")
    shaped = F.coalesce(four | three | listed | simple, F.lit(False))
    kind = F.coalesce(file_kind(href, text), F.when(listed | simple, "excel"))
    fixed = F.when(four & (F.col("cell") == 3), "informes_ciudades").when(shaped & ~three, "anexo")
    category = F.coalesce(fixed, link_kind(href, text), F.when(three, "anexo"))
    # The row's date, or the label's; where no year stands, that of the target or the page, and none in simple links.
    in_row = four | three
    said = dated_text(F.when(in_row, F.col("first")).when(listed | simple, text), F.when(in_row, F.col("year")).when(listed, F.col("page_year")))
    rows = links.select("page_id", "href", "text", kind.alias("kind"), category.alias("category"), F.coalesce(said, url_date(href)).alias("date"), shaped.alias("shaped")).filter("kind is not null")
    # A page has a bounded number of links; a window reads pages once, a join with those that have some would read them twice.
    rows = rows.withColumn("_some", F.max("shaped").over(Window.partitionBy("page_id")))
    return rows.filter("shaped or not _some").drop("shaped", "_some")


def unseen(links: DataFrame, ledger: DataFrame, key: str = "url") -> DataFrame:
    """Links that the ledger lacks."""
    return links.join(ledger.select(key), key, "left_anti")


def freshness(ledger: DataFrame, headers: DataFrame, key: str = "url") -> DataFrame:
    """``ledger`` (key, download_date text) with freshness by ``headers`` (key, last_modified): missing, stale or fresh.

    Without a header a file is fresh; a download date that cannot be read is stale.
    """
    both = ledger.join(headers, key, "full")
    stored = F.try_to_timestamp("download_date")
    state = F.when(F.col("download_date").isNull(), "missing").when(F.col("last_modified").isNull(), "fresh")
    state = state.when(stored.isNull() | (F.col("last_modified") > stored), "stale").otherwise("fresh")
    return both.withColumn("freshness", state)


def between(links: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Links dated in an inclusive range; undated ones go."""
    return links.filter(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def month_index(links: DataFrame, url: str = "url") -> DataFrame:
    """Addresses of each year and month that a page name such as '-mayo-2014' gives; a month must follow a hyphen."""
    pattern = rf"-({'|'.join(MONTHS)})-(\d{{4}})"
    name, year = F.regexp_extract(F.lower(F.col(url)), pattern, 1), F.regexp_extract(F.lower(F.col(url)), pattern, 2)
    found = links.withColumns({"year": year.try_cast("int"), "month": named_month(name)}).filter("month is not null")
    return found.groupBy("year", "month").agg(F.sort_array(F.collect_set(url)).alias("urls"))

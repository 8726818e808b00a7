"""Workbooks in the zipped XML format as typed cells.

A cell is a struct (kind, text, number, date). What a number means is told by the workbook's own styles:
a number under a date format is a date. Files come through Spark's own readers (``read_workbooks``) or, where
Arrow knows the store, through a data source: ``register(spark)``, then
``spark.read.format("workbook").option("sheets", pattern).load(path)``.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType

from cosecha.functions.text import parse_price

CELL = "struct<kind: string, text: string, number: double, date: date>"
ROWS = f"path string, sheet string, active boolean, row int, cells array<{CELL}>, problem string"
_CELL_TYPE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("number", pa.float64()), ("date", pa.date32())])
_FIELDS = [("path", pa.string()), ("sheet", pa.string()), ("active", pa.bool_()), ("row", pa.int32()), ("cells", pa.list_(_CELL_TYPE)), ("problem", pa.string())]

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PLACE = re.compile(r"([A-Z]+)(\d+)")
# Number formats of the file format that are dates.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(50, 59)}
#: Rows that a decoder hands on at a time.
_BATCH = 4096
#: Bytes of files that one task of the data source reads.
_TASK_BYTES = 64 << 20


def is_date_format(code: str) -> bool:
    """Whether a number format writes a date: a year, month or day outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|[\\_*].', "", code.split(";")[0])
    return re.search(r"[dyDY]|[mM]{3}", bare) is not None


@dataclass
class _Book:
    """What a workbook's sheets share."""

    strings: list[str]
    dates: list[bool]
    epoch: dt.date
    sheets: list[tuple[str, str, bool]]


def _texts(item: ElementTree.Element) -> str:
    # Phonetic readings of a text are not part of it.
    runs = [item, *item.findall(f"{_MAIN}r")]
    return "".join(t.text or "" for run in runs for t in run.findall(f"{_MAIN}t"))


def _open_book(book: zipfile.ZipFile) -> _Book:
    names = set(book.namelist())
    tree = lambda name: ElementTree.fromstring(book.read(name)) if name in names else None
    shared, styles, main, links = tree("xl/sharedStrings.xml"), tree("xl/styles.xml"), tree("xl/workbook.xml"), tree("xl/_rels/workbook.xml.rels")
    strings = [_texts(item) for item in shared.findall(f"{_MAIN}si")] if shared is not None else []
    dates: list[bool] = []
    if styles is not None:
        own = {int(f.get("numFmtId", -1)): is_date_format(f.get("formatCode", "")) for f in styles.iter(f"{_MAIN}numFmt")}
        for style in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf"):
            number = int(style.get("numFmtId", 0))
            dates.append(own.get(number, number in _DATE_FORMATS))
    epoch = dt.date(1899, 12, 30)
    if main is None:
        files = sorted(n for n in names if n.startswith("xl/worksheets/sheet"))
        return _Book(strings, dates, epoch, [(n.rsplit("/", 1)[-1].removesuffix(".xml"), n, k == 0) for k, n in enumerate(files)])
    if (main.find(f"{_MAIN}workbookPr") is not None) and main.find(f"{_MAIN}workbookPr").get("date1904") in ("1", "true"):
        epoch = dt.date(1904, 1, 1)
    targets = {link.get("Id"): link.get("Target", "") for link in (links if links is not None else ())}
    view = main.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    sheets = []
    for k, sheet in enumerate(main.findall(f"{_MAIN}sheets/{_MAIN}sheet")):
        target = targets.get(sheet.get(_LINK), f"worksheets/sheet{k + 1}.xml")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part in names:
            sheets.append((sheet.get("name", ""), part, k == active))
    return _Book(strings, dates, epoch, sheets)


def _cell(cell: ElementTree.Element, book: _Book) -> dict | None:
    kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return _typed("text", _texts(inline)) if inline is not None else None
    if value is None or value == "":
        return None
    if kind == "s":
        return _typed("text", book.strings[int(value)])
    if kind in ("str", "e"):
        return _typed("error" if kind == "e" else "text", value)
    if kind == "b":
        return _typed("bool", str(value not in ("0", "false")))
    if kind == "d":
        return _typed("date", value, date=dt.date.fromisoformat(value[:10]))
    number = float(value)
    style = int(cell.get("s", 0))
    if style < len(book.dates) and book.dates[style] and number >= 1:
        # Day 60 of the older calendar never was.
        days = int(number) + (number < 60 and book.epoch.year == 1899)
        date = book.epoch + dt.timedelta(days=days)
        return _typed("date", date.isoformat(), number, date)
    return _typed("number", value.removesuffix(".0"), number)


def _typed(kind: str, text: str, number: float | None = None, date: dt.date | None = None) -> dict:
    return {"kind": kind, "text": text, "number": number, "date": date}


def typed_rows(content: bytes, sheets: str | None = None) -> Iterator[tuple[str, bool, int, list[dict | None]]]:
    """(sheet, active, row from 1, cells) of a workbook, sheet by sheet; formulas count by their kept values.

    ``sheets`` is a pattern that the names of the wanted sheets match whole. Rows without cells are left out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        book = _open_book(packed)
        for name, part, active in book.sheets:
            if sheets and not re.fullmatch(sheets, name):
                continue
            with packed.open(part) as stream:
                number, holder = 0, None
                for event, element in ElementTree.iterparse(stream, ("start", "end")):
                    if event == "start":
                        holder = element if element.tag == f"{_MAIN}sheetData" else holder
                        continue
                    if element.tag != f"{_MAIN}row":
                        continue
                    number = int(element.get("r", number + 1))
                    cells: list[dict | None] = []
                    for cell in element.findall(f"{_MAIN}c"):
                        found = _PLACE.match(cell.get("r", ""))
                        place = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(found[1]))) if found else len(cells) + 1
                        cells += [None] * (place - len(cells))
                        cells[place - 1] = _cell(cell, book)
                    if any(cells):
                        yield name, active, number, cells
                    # Rows that were read do not stay in memory.
                    holder.clear()


def _batches(path: str, content: bytes, sheets: str | None) -> Iterator[pa.RecordBatch]:
    """The rows of one file; one that cannot be read becomes a row with its problem, after the rows read before."""
    rows: list[tuple] = []
    try:
        for row in typed_rows(content, sheets):
            rows.append((path, *row, None))
            if len(rows) == _BATCH:
                yield _batch(rows)
                rows = []
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, OverflowError) as broken:
        rows.append((path, None, None, None, None, f"{type(broken).__name__}: {broken}"))
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


def workbook_rows(files: DataFrame, sheets: str | None = None) -> DataFrame:
    """The rows of ``files`` (path, content), as ``ROWS``; each file is read in one task."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from _batches(path.as_py(), content.as_py() or b"", sheets)

    return files.select("path", "content").mapInArrow(decode, ROWS)


def read_workbooks(spark: SparkSession, path: str, sheets: str | None = None) -> DataFrame:
    """The typed rows of every workbook under ``path``, in any store that Spark reads."""
    return workbook_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), sheets)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")``: workbooks of a file, folder or URI that Arrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _WorkbookReader:
        return _WorkbookReader(self.options["path"], self.options.get("sheets"))


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheets: str | None) -> None:
        self._path, self._sheets = path, sheets

    def _store(self):
        return pa.fs.FileSystem.from_uri(self._path) if "://" in self._path else (pa.fs.LocalFileSystem(), self._path.removeprefix("file:"))

    def partitions(self) -> list[_Files]:
        """Files of about ``_TASK_BYTES`` together; a larger one goes by itself."""
        store, path = self._store()
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(path, recursive=True))
        tasks: list[_Files] = []
        held = 0
        for file in sorted((f for f in found if f.is_file and (info.is_file or f.base_name.lower().endswith(".xlsx"))), key=lambda f: f.path):
            if not tasks or held + file.size > _TASK_BYTES:
                tasks.append(_Files([]))
                held = 0
            tasks[-1].paths.append(file.path)
            held += file.size
        return tasks or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as stream:
                yield from _batches(path, stream.read(), self._sheets)


def register(spark: SparkSession) -> None:
    """Make ``workbook`` a format of this session's reader."""
    spark.dataSource.register(WorkbookSource)


# Cells in expressions.


def text_cell(value: Column) -> Column:
    return F.struct(F.when(value.isNotNull(), "text").alias("kind"), value.cast("string").alias("text"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("date").alias("date"))


def number_cell(value: Column) -> Column:
    return F.struct(F.when(value.isNotNull(), "number").alias("kind"), value.cast("string").alias("text"), value.cast("double").alias("number"), F.lit(None).cast("date").alias("date"))


def date_cell(value: Column) -> Column:
    days = F.datediff(value, F.lit("1899-12-30").cast("date")).cast("double")
    return F.struct(F.when(value.isNotNull(), "date").alias("kind"), value.cast("string").alias("text"), days.alias("number"), value.cast("date").alias("date"))


def typed_cells(grid: DataFrame) -> DataFrame:
    """``grid`` with cells of plain text, such as those taken from a document's tables, as typed ones."""
    kind = grid.schema["cells"].dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return grid.withColumn("cells", F.transform("cells", text_cell))
    return grid


def text_of(cell: Column) -> Column:
    """The text without outer blanks; null for an empty cell."""
    return F.nullif(F.trim(cell["text"]), F.lit(""))


def number_of(cell: Column) -> Column:
    """A number cell as it is, a text only if it writes a number with a decimal point; dates and others are none."""
    written = F.when(F.trim(cell["text"]).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(cell["text"]).try_cast("double"))
    return F.when(cell["kind"] == "number", cell["number"]).when(cell["kind"] == "text", written)


def price_of(cell: Column) -> Column:
    """A positive price: a number cell as it is, a text by dots for thousands and a comma for decimals."""
    return F.when(cell["kind"] == "number", F.when(cell["number"] > 0, cell["number"])).when(cell["kind"] == "text", parse_price(cell["text"]))


def date_of(cell: Column) -> Column:
    """A date cell's date, or that of a text that begins with year, month and day."""
    return F.coalesce(cell["date"], F.when(cell["kind"] == "text", F.try_to_timestamp(F.left(F.trim(cell["text"]), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")))

"""Table grids (file, row number, cells) to typed rows, and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cosecha.functions.text import parse_price
from cosecha.sources.workbooks import price_of, read_workbooks, text_of, typed_cells  # noqa: F401

def zipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files in every zip under ``path``, without hidden ones."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    for name in packed.namelist():
                        last = name.rsplit("/", 1)[-1]
                        if last and not last.startswith(".") and "__MACOSX" not in name:
                            yield pa.record_batch([pa.array([archive]), pa.array([name]), pa.array([packed.read(name)], pa.binary())], names=["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(unpack, "archive string, name string, content binary")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated gazetteer with department and municipality codes padded to 2 and 5 digits."""
    schema = "department_code string, department string, municipality_code string, municipality string, kind string, longitude double, latitude double"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    padded = lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(F.col(c))
    return rows.withColumns({"department_code": padded("department_code", 2), "municipality_code": padded("municipality_code", 5)})


def daily_grid(grid: DataFrame) -> DataFrame:
    """Prices of a wide daily grid (file, row, cells): file, category, product, market, price.

    The first row that names markets ('City, Market') is the header; a row whose cells
    after the first are all empty names the category of the rows below it; columns that
    start with 'Var' and cells without a price are skipped.
    """
    grid = typed_cells(grid)
    by_file = Window.partitionBy("file")
    below = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    named = F.exists(below, lambda c: F.coalesce(c["text"].contains(","), F.lit(False)))
    first = F.min(F.when(named & ~F.exists("cells", lambda c: price_of(c).isNotNull()), F.col("row"))).over(by_file)
    rows = grid.withColumn("_header", first)
    headers = rows.filter("row = _header").select("file", F.col("cells").alias("names"))
    body = rows.filter("row > _header")
    alone = ~F.exists(below, lambda c: text_of(c).isNotNull())
    body = body.withColumn("category", F.when(alone, text_of(F.get("cells", F.lit(0)))))
    filled = F.last("category", ignorenulls=True).over(by_file.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    body = body.withColumn("category", filled).filter(~alone)
    product = text_of(F.get("cells", F.lit(0)))
    cells = body.join(headers, "file").select("file", "row", "category", product.alias("product"), "names", F.posexplode("cells").alias("at", "cell"))
    market = text_of(F.get("names", F.col("at")))
    out = cells.filter("at > 0").select("file", "row", "category", "product", market.alias("market"), price_of(F.col("cell")).alias("price"))
    return out.filter(F.col("price").isNotNull() & (F.col("market") != "") & ~F.col("market").startswith("Var"))


def bulletin_rows(grid: DataFrame) -> DataFrame:
    """Prices of bulletin tables (file, row, cells: product, presentation, units, min1, max1[, min2, max2]); at most two rounds.

    A row without any price names the category of the rows below it; a round needs its first bound, the second both.
    """
    price = lambda k: parse_price(F.get("cells", F.lit(k)))
    priced = F.coalesce(*(price(k) for k in range(3, 7)))
    head = F.when(priced.isNull(), F.trim(F.get("cells", F.lit(0))))
    filled = F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.withColumn("category", filled).filter(priced.isNotNull())
    cell = lambda k: F.trim(F.get("cells", F.lit(k)))
    base = ["file", "row", "category", cell(0).alias("product"), cell(1).alias("presentation"), cell(2).alias("units")]
    bounds = lambda k: F.struct(F.lit(k + 1).alias("round"), price(3 + 2 * k).alias("min_price"), price(4 + 2 * k).alias("max_price"))
    each = rows.select(*base, F.explode(F.array(bounds(0), bounds(1))).alias("r")).select("file", "row", "category", "product", "presentation", "units", "r.*")
    return each.filter("min_price is not null and (round = 1 or max_price is not null)")

"""Writers: append, insert-if-absent, upsert, replace by source, exports and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosecha.functions.columns import first_per_key

#: Prices beyond this do not fit the fact tables.
LARGEST_PRICE = 9_999_999_999.99


def append_by_month(rows: DataFrame, path: str, date: str) -> None:
    """Append ``rows`` to a table that is partitioned by the month of ``date``."""
    rows.withColumn("month", F.date_format(date, "yyyy-MM")).repartition("month", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("append").partitionBy("month").parquet(path)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose key it lacks, one of each key."""
    fresh = incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row of each key: of both tables the one with the largest ``newest``, the incoming one on ties."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.select(*existing.columns).withColumn("_side", F.lit(1)))
    return first_per_key(both, keys, F.desc_nulls_last(newest), F.desc("_side")).drop("_side")


def replace_by_source(rows: DataFrame, path: str, source: str) -> None:
    """Rewrite only the partitions of the sources that ``rows`` holds."""
    rows.repartition(source).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def split_rejects(rows: DataFrame, price: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose price fits, and the others with the reason: no number, or too large."""
    number = F.col(price).try_cast("double")
    reason = F.when(F.col(price).isNotNull() & number.isNull(), "not_a_number").when(F.abs(number) > LARGEST_PRICE, "overflow")
    marked = rows.withColumn("error_type", reason)
    return marked.filter("error_type is null").drop("error_type"), marked.filter("error_type is not null")


def dead_letters(rejects: DataFrame, path: str, source: str) -> None:
    """Append rejected rows (with error_type) to a table of errors: the row as JSON, its source, and how often it was tried."""
    data = F.to_json(F.struct(*[c for c in rejects.columns if c != "error_type"]))
    out = rejects.select("error_type", data.alias("row_data"), F.col(source).cast("string").alias("source"), F.lit(0).alias("retry_count"), F.lit(False).alias("resolved"))
    out.write.mode("append").parquet(path)


def markdown(rows: DataFrame, most: int = 500) -> str:
    """A table of a report's few rows as Markdown; more than ``most`` are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, found)])


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header, such as a snapshot of names."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def reviewed_names(values: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """(raw, name): the name that a reviewer gave a raw value, else its standard form, else itself. ``mapping``: raw, canonical, standardized."""
    raw = values.select("raw").filter("raw != ''").distinct()
    if mapping is None:
        return raw.withColumn("name", F.col("raw"))
    one = mapping.groupBy("raw").agg(F.min(F.nullif("canonical", F.lit(""))).alias("_c"), F.min(F.nullif("standardized", F.lit(""))).alias("_s"))
    return raw.join(one, "raw", "left").select("raw", F.coalesce("_c", "_s", "raw").alias("name"))


def export_tsv(rows: DataFrame, path: str) -> None:
    """A tab-separated folder with a header in each file."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def latest_state(ledger: DataFrame, key: str, changed: str) -> DataFrame:
    """The newest row of each key of an append-only ledger."""
    return first_per_key(ledger, [key], F.desc(changed))

"""Incremental ingest of priced rows: facts, dead letters, members and the ledger of sources change together, once for each micro-batch.

A source (a file, a document) comes with the time it was changed last. What the ledger has with that time or a later one
is not read again; a later one replaces all that the source brought before. Rows that cannot be taken wait in
a queue, which is a stream of its own: each run tries them again, up to ``TRIES`` times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cosecha.functions.text import parse_price, split_at_last_comma
from cosecha.operators import resolver
from cosecha.sources.snapshots import Store

#: How often a row is tried, the first time included.
TRIES = 3
ROWS = "source string, last_modified timestamp, place string, product string, category string, price_date date, price string"
QUEUE = f"{ROWS}, error_id string, error_type string, tries int"
TABLES = {
    "facts": "source string, place string, product_id string, city_id string, market_id string, price_date date, price double",
    "errors": "source string, error_id string, error_type string, row_data string, tries int, resolved boolean",
    "ledger": "source string, last_modified timestamp, facts long, errors long",
    "members": "kind string, member_id string, name string, parent_id string",
    "aliases": "kind string, raw_value string, member_id string",
}
_KEYS = {"facts": "source", "errors": "source", "ledger": "source", "members": "name", "aliases": "raw_value"}


def open_store(spark: SparkSession, path: str) -> Store:
    """The tables of an ingest below ``path``."""
    return Store(spark, f"{path}/tables", TABLES, _KEYS)


@contextmanager
def _steps(store: Store, path: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that makes a table of what a micro-batch works out, so that plans stay small; the tables go at its end."""
    folder, made = f"{path}/work/{uuid.uuid4().hex}", []

    def keep(frame: DataFrame) -> DataFrame:
        made.append(f"{folder}/{len(made)}")
        frame.write.parquet(made[-1])
        return frame.sparkSession.read.schema(frame.schema).parquet(made[-1])

    try:
        yield keep
    finally:
        store.delete(folder)


def _settled(store: Store, rows: DataFrame, gazetteer: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """``rows`` with price, product_id, city_id, market_id and what is wrong with them; the members and the aliases to add, by kind.

    What a micro-batch has of distinct names is worked out once, as tables by ``keep``.
    """

    def resolved(found: resolver.Resolution) -> resolver.Resolution:
        return resolver.Resolution(*map(keep, (found.found, found.members, found.aliases)))

    members, aliases = store.read("members"), store.read("aliases")
    of = lambda table, kind: table.filter(F.col("kind") == kind).drop("kind")
    city_text = split_at_last_comma(F.col("place"))["city"]
    typed = keep(rows.withColumns({"amount": parse_price(F.col("price")), "city_text": city_text}))
    good = typed.filter("amount is not null")

    cities = resolved(resolver.resolve_cities(good.select(F.col("city_text").alias("raw_value")), of(members, "city"), of(aliases, "city"), gazetteer, keep))
    named = of(members, "city").select("member_id", "name").unionByName(cities.members.select("member_id", "name"))
    city = cities.found.select(F.col("raw_value").alias("city_text"), F.col("member_id").alias("city_id"))
    known = keep(good.join(city, "city_text").filter("city_id is not null").select("place", "city_id", "product", "category").distinct())
    places = known.select("place", "city_id").distinct().join(named.select(F.col("member_id").alias("city_id"), F.col("name").alias("city")), "city_id")
    markets = resolved(resolver.resolve_markets(places, of(members, "market"), of(aliases, "market")))
    general = resolver.member_id("subcategory", F.concat(F.lit("General ("), F.coalesce("category", F.lit("Unknown")), F.lit(")")))
    products = resolved(resolver.resolve_or_create(known.select(F.col("product").alias("raw_value"), "category"), "product", of(members, "product"), of(aliases, "product"), general, keep))

    market = markets.found.select(F.col("raw_value").alias("place"), F.col("member_id").alias("market_id"))
    product = products.found.select(F.col("raw_value").alias("product"), F.col("member_id").alias("product_id"))
    whole = typed.join(city, "city_text", "left").join(market, "place", "left").join(product, "product", "left")
    wrong = F.when(F.col("amount").isNull(), "non_numeric_price").when(F.col("city_id").isNull(), "unknown_city").when(F.col("product_id").isNull(), "missing_product")
    kinds = {"city": cities, "market": markets, "product": products}
    return whole.withColumn("error_type", wrong), {k: r.members for k, r in kinds.items()}, {k: r.aliases for k, r in kinds.items()}


def _grown(store: Store, members: dict[str, DataFrame], aliases: dict[str, DataFrame]) -> dict[str, tuple[list[int], DataFrame]]:
    """Contents of the member and alias buckets that the additions touch."""
    out = {}
    for table, added, key in (("members", members, "member_id"), ("aliases", aliases, "raw_value")):
        rows = None
        for kind, some in added.items():
            one = some.withColumn("kind", F.lit(kind))
            rows = one if rows is None else rows.unionByName(one)
        buckets = store.touched(table, rows)
        if buckets:
            old = store.read(table, buckets)
            out[table] = (buckets, old.unionByName(rows.select(*old.columns).dropDuplicates(["kind", key]).join(old.select("kind", key), ["kind", key], "left_anti")))
    return out


def _facts(rows: DataFrame) -> DataFrame:
    return rows.filter("error_type is null").select("source", "place", "product_id", "city_id", "market_id", "price_date", F.col("amount").alias("price"))


def _row_data(rows: DataFrame):
    return F.to_json(F.struct(*[c.split()[0] for c in ROWS.split(", ")]))


def _queue(rows: DataFrame, path: str, name: str) -> None:
    """The rows that wait for another try, in a folder of their micro-batch: a repeated one writes it again."""
    rows.select(*[c.split()[0] for c in QUEUE.split(", ")]).write.mode("overwrite").parquet(f"{path}/queue/{name}")


def take(store: Store, path: str, batch: DataFrame, number: int, gazetteer: DataFrame) -> bool:
    """One micro-batch of ``ROWS``; False if it was taken before. Of a source that comes in several versions the newest counts."""
    if store.manifest()["batches"].get("ingest", -1) >= number:
        return False
    with _steps(store, path) as keep:
        versions = batch.groupBy("source").agg(F.max("last_modified").alias("last_modified"))
        buckets = store.touched("ledger", versions)
        known = store.read("ledger", buckets)
        stale = versions.join(known.select("source", F.col("last_modified").alias("_had")), "source", "left").filter("_had is null or last_modified > _had").drop("_had")
        stale = keep(stale)
        rows, members, aliases = _settled(store, batch.join(stale, ["source", "last_modified"]), gazetteer, keep)
        rows = keep(rows.withColumn("error_id", F.when(F.col("error_type").isNotNull(), F.sha2(_row_data(rows), 256))))
        bad = rows.filter("error_type is not null").withColumn("tries", F.lit(1))
        errors = bad.select("source", "error_id", "error_type", _row_data(rows).alias("row_data"), "tries", F.lit(False).alias("resolved"))
        counts = rows.groupBy("source").agg(F.count_if(F.col("error_type").isNull()).alias("facts"), F.count("error_type").alias("errors"))
        ledger = stale.join(counts, "source").select("source", "last_modified", "facts", "errors")
        _queue(bad, path, f"batch={number}")
        replaced = lambda table, new: (buckets, store.read(table, buckets).join(stale.select("source"), "source", "left_anti").unionByName(new))
        contents = {"facts": replaced("facts", _facts(rows)), "errors": replaced("errors", errors), "ledger": replaced("ledger", ledger)}
        return store.change(contents | _grown(store, members, aliases), "ingest", number)


def retry(store: Store, path: str, waiting: DataFrame, number: int, gazetteer: DataFrame) -> bool:
    """One micro-batch of ``QUEUE``: what can be taken now becomes facts and its error is resolved; the rest waits again, with one try more.

    Rows of a source that was replaced since do not count any more.
    """
    if store.manifest()["batches"].get("retry", -1) >= number:
        return False
    with _steps(store, path) as keep:
        buckets = store.touched("errors", waiting)
        open_ = store.read("errors", buckets).filter("not resolved").select("source", "error_id")
        rows, members, aliases = _settled(store, waiting.join(open_, ["source", "error_id"], "left_semi").drop("error_type"), gazetteer, keep)
        rows = keep(rows.withColumn("tries", F.col("tries") + 1))
        _queue(rows.filter(F.col("error_type").isNotNull() & (F.col("tries") < TRIES)), path, f"batch=retry-{number}")
        now = rows.groupBy("source", "error_id").agg(F.max("tries").alias("_tries"), F.bool_and(F.col("error_type").isNull()).alias("_done"), F.max("error_type").alias("_type"))
        errors = store.read("errors", buckets).join(now, ["source", "error_id"], "left")
        errors = errors.withColumns({"tries": F.coalesce("_tries", "tries"), "resolved": F.coalesce("_done", "resolved"), "error_type": F.coalesce("_type", "error_type")}).drop("_tries", "_done", "_type")
        facts = store.read("facts", buckets).unionByName(_facts(rows))
        return store.change({"facts": (buckets, facts), "errors": (buckets, errors)} | _grown(store, members, aliases), "retry", number)


def _drain(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(spark: SparkSession, incoming: str, path: str, gazetteer: DataFrame) -> Store:
    """Take the files that came into the folder ``incoming`` since the last run.

    They are one micro-batch: a source's rows may stand in several files, and a bucket is rewritten once.
    """
    store = open_store(spark, path)
    stream = spark.readStream.schema(ROWS).parquet(incoming)
    _drain(stream, lambda batch, number: take(store, path, batch, number, gazetteer), f"{path}/checkpoints/ingest")
    return store


def retry_errors(spark: SparkSession, path: str, gazetteer: DataFrame) -> Store:
    """Try the rows that wait since the last run again."""
    store = open_store(spark, path)
    stream = spark.readStream.schema(QUEUE).option("recursiveFileLookup", "true").parquet(f"{path}/queue")
    _drain(stream, lambda waiting, number: retry(store, path, waiting, number, gazetteer), f"{path}/checkpoints/retry")
    return store

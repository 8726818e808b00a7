"""Queries over sources, sinks and streams, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosecha.functions.text import MONTHS
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views
from cosecha.session import shared_folder
from cosecha.functions.columns import first_per_key
from cosecha.sources import links, sinks
from cosecha.streaming import feeds

registry = Registry()

_ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


@registry.query("A1_page_links", f"""
SELECT page_id, CAST(place - 1 AS INTEGER) AS place, href, trim(regexp_replace(label, '<[^>]*>', '', 'g')) AS text FROM (
  SELECT page_id, UNNEST(generate_series(1, len(h))) AS place, UNNEST(h) AS href, UNNEST(t) AS label
  FROM (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS h, regexp_extract_all(html, '{_ANCHOR}', 2) AS t FROM pages))""")
def page_links(spark, sf_dir):
    return links.anchors(Views(spark, sf_dir).table("pages"))


def _files(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    name = F.get(F.array(*map(F.lit, MONTHS)), F.month(date) - 1)
    day, year = F.dayofmonth(date).cast("string"), F.year(date).cast("string")
    kind = F.col("o_orderkey") % 3
    form = F.when(kind == 0, F.concat(day, F.left(name, F.lit(3)), year, F.lit(".xlsx"))).when(kind == 1, F.concat(F.lit("mayoristas_"), name, F.lit("_"), day, F.lit("_"), year, F.lit(".pdf")))
    form = form.otherwise(F.concat(F.lit("bol-reg-"), F.date_format(date, "dd-MM-yyyy"), F.lit(".zip")))
    return Views(spark, sf_dir).table("orders").select("o_orderkey", F.concat(F.lit("https://example.org/files/"), form).alias("url"))


@registry.query("A2_file_dates", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CASE o_orderkey % 3 WHEN 0 THEN 'excel' WHEN 1 THEN 'pdf' ELSE 'zip' END AS kind,
  CASE o_orderkey % 3 WHEN 1 THEN 'boletin' WHEN 2 THEN 'boletin' END AS category FROM orders""")
def file_dates(spark, sf_dir):
    url = F.col("url")
    return _files(spark, sf_dir).select("o_orderkey", links.url_date(url).cast("string").alias("date"), links.file_kind(url).alias("kind"), links.link_kind(url, F.lit("")).alias("category"))


@registry.query("A6_unseen_links", "SELECT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1999-01-01')")
def unseen_links(spark, sf_dir):
    orders = Views(spark, sf_dir).table("orders").select(F.col("o_custkey").alias("key"), "o_orderdate")
    return links.unseen(orders, orders.filter("o_orderdate < date '1999-01-01'"), "key").select("key")


_UPSERT = "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@registry.query("B5_upsert", _UPSERT.replace("CAST(o_orderdate AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d')"))
def upsert(spark, sf_dir):
    orders = Views(spark, sf_dir).table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = first_per_key(orders, ["o_custkey", "o_orderdate"], F.desc("o_orderkey"))
    old, new = newest.filter("o_orderdate < date '1999-01-01'"), newest.filter("o_orderdate >= date '1999-01-01'")
    last = lambda rows: sinks.latest_state(rows, "o_custkey", "o_orderdate")
    return sinks.upsert(last(old), last(new), ["o_custkey"], "o_orderdate").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@registry.query("B6_replace_by_source", "SELECT o_orderpriority, COUNT(*) AS orders, MIN(o_orderkey) AS first FROM orders GROUP BY o_orderpriority")
def replace_by_source(spark, sf_dir):
    orders = Views(spark, sf_dir).table("orders").select("o_orderkey", "o_orderpriority")
    path = shared_folder(spark, "replaced")
    # The second load of one source replaces its rows and no others.
    sinks.replace_by_source(orders, path, "o_orderpriority")
    sinks.replace_by_source(orders.filter("o_orderpriority = '1-URGENT'"), path, "o_orderpriority")
    rows = spark.read.schema("o_orderkey long, o_orderpriority string").parquet(path)
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first"))


_DAILY = """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, COUNT(*) AS events, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM (SELECT *, date_trunc('day', ts) AS w FROM events) {0} GROUP BY w, event_type"""


@registry.query("N_tumbling_windows", _DAILY.format(""))
def tumbling_windows(spark, sf_dir):
    return feeds.windowed(Views(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")


@registry.query("N_stream_tumbling_windows", _DAILY.format("WHERE w + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR"))
def stream_tumbling_windows(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    stream = feeds.windowed(feeds.read_feed(spark, f"{sf_dir}/events.parquet"), "1 day")
    return feeds.drain(stream, f"{folder}/out", f"{folder}/checkpoint")


@registry.query("N_sliding_windows", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, COUNT(*) AS events, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS w FROM events, (SELECT UNNEST([0, 1]) AS k)) GROUP BY w, event_type""")
def sliding_windows(spark, sf_dir):
    return feeds.windowed(Views(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours", "6 hours")


@registry.query("N_sessions", """
WITH marked AS (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts) + INTERVAL 30 MINUTE) AS end_us, COUNT(*) AS events FROM numbered GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    return feeds.sessions(Views(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp")))

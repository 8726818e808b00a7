"""Streams over the price feed: windows with watermarks, deduplication and replacement by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosecha.sources.sinks import replace_by_source


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed (a file or a folder) as a stream of events with a proper timestamp."""
    schema = spark.read.parquet(path).schema
    # A stream reads folders or patterns: this one matches the path and nothing else.
    exact = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(exact)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and total by event type and tumbling or sliding window; a batch or a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    totals = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return totals.select(F.col("w.start").cast("string").alias("window_start"), F.col("w.end").cast("string").alias("window_end"), "event_type", "events", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, runs of events less than ``gap`` apart, with bounds in microseconds."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return rows.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run ``stream`` over what its source has, to a table, and read that: finished windows only."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def replace_sources(stream: DataFrame, path: str, source: str, checkpoint: str) -> None:
    """Each micro-batch replaces the partitions of the sources that it brings, so that a repeated batch changes nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, _: replace_by_source(batch, path, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

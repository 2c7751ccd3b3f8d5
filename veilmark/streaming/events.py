"""Structured Streaming extension: event-time windows with late data, repeated events, running site counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream with its watermark; times without a zone are taken in the session's zone, as watermarks need one."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming and late else events


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str | None = "30 minutes") -> DataFrame:
    """(start, key, n, total) by tumbling (or sliding) event-time windows; batch or stream. late is None for a stream that
    has its watermark already, as a stream can have one only."""
    rows = _watermarked(events, time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, stop, key, n) by sessions that end after a gap."""
    rows = _watermarked(events, time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def once(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Repeated deliveries dropped; a stream keeps state for the lateness only."""
    return _watermarked(events, time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stream_of(spark, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

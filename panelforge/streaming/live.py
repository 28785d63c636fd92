"""Streams of events: windows, sessions, deduplication, running panels; each takes a batch frame as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files; all files at hand are one batch unless files_per_trigger says otherwise.

    With several batches the watermark moves between them, so files that are not listed in event
    order can hold rows that are late by then: give `delay` the files' disorder in that case.
    """
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def late(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 hour", time="ts", key="event_type", value="value") -> DataFrame:
    w = late(events, time, delay).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", delay: str = "1 hour", time="ts", key="event_type") -> DataFrame:
    w = late(events, time, delay).groupBy(F.window(time, size, step), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", time="ts", key="user_id") -> DataFrame:
    w = late(events, time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour", time="ts") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def append_panel(events: DataFrame, path: str, checkpoint: str, size: str = "1 day", delay: str = "1 hour"):
    """Closed windows go to a panel folder once; the query ends when the input at hand is read."""
    out = tumbling(events, size, delay).select(F.col("event_type").alias("series_id"), F.col("window_start").cast("date").alias("week"), F.col("n").cast("double").alias("quantity"))
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query) -> int:
    """Rows (partial sums where they were summed before) that a query left out as later than its watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])

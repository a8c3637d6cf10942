"""Windowed sums over an event stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Count and sum per event type and tumbling window; works on a stream (with its watermark) and on a table alike."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def running(spark, folder: str, schema: str, checkpoint: str, target: str, **options):
    """``windowed`` over files as they arrive, appended to ``target`` once a window can't change."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return windowed(stream, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

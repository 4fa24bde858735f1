"""Windowed statistics of events; the same plan serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total per tumbling window of ``ts``.

    On a stream, events later than ``lateness`` behind the latest are dropped and
    a window's state goes once it is complete; on a table nothing is late.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    per = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")

"""The unit rollup over a stream of records: the same aggregates, kept up to date by day.

Batch has no late data; a stream does, so a watermark bounds how long a window's state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_rollup(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", late: str = "2 days") -> DataFrame:
    """Null-preserving sums and counts by day and key; works on a streaming and on a batch DataFrame alike."""
    d = events.withColumn("_at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("_at", late)
    return d.groupBy(F.window("_at", "1 day").alias("w"), F.col(key)).agg(
        F.sum(value).alias("value"), F.count("*").alias("source_rows"), F.count(value).alias("reported_rows")).select(F.col("w.start").cast("date").alias("day"), key, "value", "source_rows", "reported_rows")

"""Monthly means of an event stream, for panels that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_means(events: DataFrame, time: str, keys: list[str], value: str, lateness: str = "7 days") -> DataFrame:
    """Count and mean by key and calendar month; works on streams, where late rows count up to ``lateness``.

    State is kept by key and month until the watermark has passed it by.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, lateness) if events.isStreaming else rows
    # streams drop state by a window on the event time; its start gives the month
    by = [F.window(time, "1 day").alias("day"), *keys] if events.isStreaming else [*keys]
    if events.isStreaming:
        daily = rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
        return daily.select(*keys, F.trunc(F.col("day.start").cast("date"), "month").alias("m"), F.col("day.start").cast("date").alias("day"), "n", "total")
    month = F.trunc(F.col(time).cast("date"), "month").alias("m")
    return rows.groupBy(*keys, month).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))

"""The event features over a stream. This goes beyond the batch engine's own scope.

Late events count as long as the watermark lets them; a day's count is final once it has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def daily_counts(events: DataFrame, ts: str = "publish_ts", by: str = "ticker", delay: str = "1 day") -> DataFrame:
    """(by, day, n): events of each market day."""
    rows = events.withColumn("__local", clock.market_time(F.col(ts)).cast("timestamp")).withWatermark("__local", delay)
    counts = rows.groupBy(F.window("__local", "1 day"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(by, F.to_date("window.start").alias("day"), "n")


def session_bursts(events: DataFrame, ts: str = "publish_ts", by: str = "ticker", gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """(by, start, end, n): runs of events with less than `gap` between neighbours."""
    rows = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", delay)
    counts = rows.groupBy(F.session_window("__at", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

"""An extension: how often a detector accepts a stream's values, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detectors import Detector


def detector_rates(stream: DataFrame, detector: Detector, column: str, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start, n, pass_rate`` for each window of a streaming or static frame; values later than ``late`` behind the newest are dropped by the watermark."""
    rows = stream.select(F.col(time).cast("timestamp").alias("t"), F.col(column).cast("string").alias("v")).withWatermark("t", late)
    return rows.groupBy(F.window("t", window)["start"].alias("start")).agg(F.count("v").alias("n"), F.avg(detector(F.col("v")).cast("int")).alias("pass_rate"))

"""Speaking time by window over a stream of segments.  A Spark extra: late segments count while the watermark allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speaking_time(segments: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """rec_id, speaker, window_ms (its start), total_ms and n of segments (rec_id, start_ms, end_ms, speaker)."""
    timed = segments.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late)
    sums = timed.groupBy("rec_id", "speaker", F.window("at", window).alias("w")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").alias("n"))
    return sums.select("rec_id", "speaker", F.unix_millis("w.start").alias("window_ms"), "total_ms", "n")

"""Streaming alerts over metric points: watermarked 600 s aligned max, breach
filter, and 1800 s incident sessions. Append mode emits each window / session
once the watermark passes it; state older than the watermark is dropped, so
state stays bounded by the lateness allowance, not by history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _event_time(points: DataFrame) -> DataFrame:
    # watermarks need TIMESTAMP (session-zone) event time; points carry NTZ
    return points.withColumn("ts", F.col("ts").cast("timestamp"))


def aligned_breaches(points: DataFrame, threshold: float, seconds: int = 600, lateness: str = "30 minutes") -> DataFrame:
    return (
        _event_time(points)
        .withWatermark("ts", lateness)
        .groupBy("series", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.max("value").alias("max_value"))
        .filter(F.col("max_value") > threshold)
        .select("series", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "max_value")
    )


def incident_sessions(points: DataFrame, threshold: float, gap_seconds: int = 1800, lateness: str = "30 minutes") -> DataFrame:
    return (
        _event_time(points)
        .filter(F.col("value") > threshold)
        .withWatermark("ts", lateness)
        .groupBy("series", F.session_window("ts", f"{gap_seconds} seconds").alias("s"))
        .agg(F.count(F.lit(1)).alias("breach_points"), F.max("value").alias("peak_value"))
        .select("series", F.col("s.start").cast("timestamp_ntz").alias("opened_at"),
                F.col("s.end").cast("timestamp_ntz").alias("closed_at"), "breach_points", "peak_value")
    )

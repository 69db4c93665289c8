"""Staging normalisation, record hash, calendar dates and temporal flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.exprs import fingerprint64, nullif_trim, ts_text


def stage_events(raw: DataFrame) -> DataFrame:
    """Raw events -> ``stg_events`` (one row per physical raw row).

    Pure projection: no shuffle, stays inside one codegen stage."""
    ts = F.col("event_timestamp")
    ref_date = F.coalesce(F.col("processing_date"), F.to_date("ingested_at"))
    ts_date = F.to_date(ts)
    return raw.select(
        "event_id",
        nullif_trim("user_id").alias("user_id"),
        F.trim("event_name").alias("event_name"),
        "event_timestamp",
        "event_date",
        F.upper(nullif_trim("country_code")).alias("country_code"),
        F.lower(nullif_trim("platform")).alias("platform"),
        nullif_trim("app_version").alias("app_version"),
        "ingested_at",
        "source_file",
        "pipeline_run_id",
        "batch_id",
        "processing_date",
        fingerprint64(F.col("event_id"), ts_text(ts), F.col("source_file"), F.col("pipeline_run_id")).alias(
            "raw_record_hash"
        ),
        ts_date.alias("event_timestamp_date"),
        F.to_date("ingested_at").alias("ingested_date"),
        (ts_date > ref_date).alias("is_future_dated"),
        (ts_date < ref_date).alias("is_event_time_late_arriving"),
        (F.col("event_date") < ref_date).alias("is_backdated_event_date"),
        (F.col("event_date") != ts_date).alias("has_event_date_timestamp_mismatch"),
    )


def temporal_flags(stg: DataFrame) -> DataFrame:
    """Per (event_date, batch scope) counts of the four temporal flags."""
    return stg.groupBy("event_date", F.coalesce("batch_id", "pipeline_run_id").alias("batch_scope")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("is_future_dated").alias("future_dated_count"),
        F.count_if("is_event_time_late_arriving").alias("event_time_late_count"),
        F.count_if("is_backdated_event_date").alias("backdated_event_date_count"),
        F.count_if("has_event_date_timestamp_mismatch").alias("date_timestamp_mismatch_count"),
    )

"""Publishing: dimensions, fact (full build, lookback, backfill, keyed merge), daily mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators.classify import country_seed
from lakeward.schemas import FACT_COLUMNS, LOOKBACK_DAYS


def _now(now):
    return now if now is not None else F.current_timestamp()


def dim_countries(spark: SparkSession, *, now=None) -> DataFrame:
    """One row per seed code, inactive ones included."""
    return country_seed(spark).withColumn("updated_at", _now(now))


def dim_users(accepted: DataFrame, *, now=None) -> DataFrame:
    """First/last event and event count per user over accepted events.

    Partial (map-side) aggregation keeps a hot user from overloading one task."""
    return (
        accepted.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.min("event_timestamp").alias("first_event_at"),
            F.max("event_timestamp").alias("last_event_at"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .withColumn("updated_at", _now(now))
    )


def fact_rows(accepted: DataFrame, *, now=None) -> DataFrame:
    """Fact projection of accepted events (one row per event id)."""
    return accepted.select(
        *FACT_COLUMNS,
        F.col("classified_at").alias("loaded_to_core_at"),
        _now(now).alias("updated_at"),
    )


def lookback_source(accepted: DataFrame, target_max_ingested_at, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Incremental source: accepted rows ingested at or after
    ``coalesce(max(target.ingested_at), epoch) - lookback_days``.

    ``target_max_ingested_at`` is a Column (scalar subquery form) or a Python
    datetime / None (value already read from the target's footer stats)."""
    if isinstance(target_max_ingested_at, (dt.datetime, type(None))):
        mx = F.lit(target_max_ingested_at or dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    else:
        mx = F.coalesce(target_max_ingested_at, F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"))
    return accepted.filter(F.col("ingested_at") >= mx - F.make_dt_interval(days=F.lit(lookback_days)))


def max_ingested_at(target: DataFrame):
    """Scalar max(ingested_at) of the target (one aggregate row)."""
    return target.agg(F.max("ingested_at").alias("m")).first()["m"]


def backfill_window(df: DataFrame, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Optional inclusive event_date bounds (partition-prunable on the fact)."""
    if start_date is not None:
        df = df.filter(F.col("event_date") >= F.lit(start_date).cast("date"))
    if end_date is not None:
        df = df.filter(F.col("event_date") <= F.lit(end_date).cast("date"))
    return df


def merge_by_key(target: DataFrame, source: DataFrame, key: str | list[str] = "event_id") -> DataFrame:
    """Upsert: source rows replace target rows with the same key; no deletes.

    One shuffle join of the target's keys against the source's keys; the
    source is de-duplicated upstream (the canonical rank guarantees one row per
    event id)."""
    keys = [key] if isinstance(key, str) else list(key)
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def daily_event_mart(fact: DataFrame, *, now=None) -> DataFrame:
    """(event_date, event_name, country_code, platform) -> counts."""
    return (
        fact.groupBy("event_date", "event_name", "country_code", "platform")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.countDistinct("user_id").alias("distinct_user_count"),
            F.count_if("is_backdated_event_date").alias("backdated_event_date_count"),
            F.count_if("has_event_date_timestamp_mismatch").alias("event_date_timestamp_mismatch_count"),
            F.count_if("is_event_time_late_arriving").alias("event_time_late_arriving_count"),
        )
        .withColumn("updated_at", _now(now))
    )

"""Warehouse cost attribution over a job-history table (nested labels).

Each report is a filter + grouped aggregation; the label predicate is a
higher-order ``exists`` over the labels array, so no explode/join is needed.
``window_days`` bounds the trailing window ending at ``as_of``; None = all
history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.exprs import sunday_week
from lakeward.operators.monitors import has_label
from lakeward.sources.adapters import APP_LABEL, PLATFORM_IDENTITIES

USD_PER_TIB = 6.25


def label_value(labels: str | Column, key: str) -> Column:
    """Value of ``key`` in an ARRAY<STRUCT<key,value>> (NULL if absent)."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.filter(c, lambda l: l["key"] == key)[0]["value"]


def _scope(jobs: DataFrame, as_of, window_days: int | None, exclude_scripts: bool = True, labelled: bool = True) -> DataFrame:
    if window_days is not None:
        jobs = jobs.filter(
            F.col("creation_time") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(window_days))
        )
    if labelled:
        jobs = jobs.filter(has_label("labels", *APP_LABEL))
    if exclude_scripts:
        jobs = jobs.filter(F.col("statement_type") != "SCRIPT")
    return jobs


def cost_daily(jobs: DataFrame, as_of=None, window_days: int | None = None) -> DataFrame:
    return (
        _scope(jobs, as_of, window_days)
        .groupBy(F.to_date("creation_time").alias("usage_date"))
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            F.sum("total_bytes_processed").alias("bytes_processed"),
            F.sum("total_bytes_billed").alias("bytes_billed"),
        )
        .withColumn("approx_usd_on_demand", F.round(F.col("bytes_billed") / F.pow(F.lit(2), 40) * USD_PER_TIB, 4))
    )


def cost_slots_daily(jobs: DataFrame, as_of=None, window_days: int | None = None) -> DataFrame:
    return (
        _scope(jobs, as_of, window_days)
        .groupBy(F.to_date("creation_time").alias("usage_date"))
        .agg(F.sum("total_slot_ms").alias("slot_ms"))
    )


def cost_failures(jobs: DataFrame, as_of=None, window_days: int | None = None) -> DataFrame:
    return (
        _scope(jobs, as_of, window_days, exclude_scripts=False)
        .filter(F.col("error_result").isNotNull())
        .groupBy(F.to_date("creation_time").alias("usage_date"), F.col("error_result.reason").alias("error_reason"))
        .agg(F.count(F.lit(1)).alias("failed_jobs"))
    )


def cost_by_component(jobs: DataFrame, as_of=None, window_days: int | None = None) -> DataFrame:
    return (
        _scope(jobs, as_of, window_days)
        .groupBy(label_value("labels", "component").alias("component"))
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            F.sum("total_bytes_billed").alias("bytes_billed"),
            F.sum("total_slot_ms").alias("slot_ms"),
        )
    )


def cost_top_jobs(jobs: DataFrame, as_of=None, window_days: int | None = None, k: int = 50, min_bytes: int = 2**30) -> DataFrame:
    """Top-k expensive jobs (> 1 GiB billed): a distributed TakeOrdered."""
    return (
        _scope(jobs, as_of, window_days)
        .filter(F.col("total_bytes_billed") > min_bytes)
        .select(
            "creation_time", "job_id", "user_email", label_value("labels", "component").alias("component"),
            "total_bytes_billed", "total_slot_ms",
        )
        .orderBy(F.col("total_bytes_billed").desc(), F.col("job_id").asc())
        .limit(k)
    )


def cost_weekly(jobs: DataFrame, as_of=None, window_days: int | None = None) -> DataFrame:
    """Sunday-start weeks: labelled vs unlabelled jobs among labelled or
    platform-identity jobs."""
    labelled = has_label("labels", *APP_LABEL)
    scoped = _scope(jobs, as_of, window_days, labelled=False).filter(
        labelled | F.col("user_email").isin(*PLATFORM_IDENTITIES)
    )
    return scoped.groupBy(sunday_week("creation_time").alias("week_start")).agg(
        F.count_if(labelled).alias("labeled_jobs"),
        F.count_if(~labelled).alias("unlabeled_jobs"),
        F.sum("total_bytes_billed").alias("bytes_billed"),
    )

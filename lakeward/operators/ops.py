"""Operational lookups over the ops tables (runs, tasks, deployments, ledger).

"Latest" lookups are ``max_by`` partial aggregations per group (no global
sort); expected-vs-seen comparisons are explode + anti joins (no cross join).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["SUCCESS", "FAILED", "SKIPPED", "UPSTREAM_FAILED"]

# Rows that one task of an aggregate over unique keys holds. Up to 200 partitions (spark.shuffle.sort.bypassMergeThreshold)
# tasks write a shuffle without buffering their rows; so there are more only where tasks would hold over MOST_PER_TASK.
ROWS_PER_TASK, MOST_PER_TASK, UNBUFFERED = 500_000, 2_000_000, 200


def latest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Newest row per key group under a total order (``order`` then nothing
    else: callers end ``order`` with a unique id).

    Two passes instead of a sort of all rows: the greatest first order column per group is a hash aggregate over two or
    three columns, and only the rows that have it are compared in full."""
    top = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(order[0]).alias("_top"))
    same = F.col(order[0]).eqNullSafe(F.col("_top"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    newest = df.join(top, same, "left_semi")
    return newest.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def latest_run(runs: DataFrame) -> DataFrame:
    return latest_by(runs, ["environment"], ["started_at", "pipeline_run_id"], ["pipeline_run_id", "status", "started_at"])


def rollback_target(deployments: DataFrame, exclude_sha: str | None = None) -> DataFrame:
    """Latest successful deployment per environment, optionally excluding a sha."""
    d = deployments.filter(F.col("status") == "SUCCESS")
    if exclude_sha is not None:
        d = d.filter(F.col("git_sha") != exclude_sha)
    return latest_by(d, ["environment"], ["completed_at", "deployment_id"], ["deployment_id", "git_sha", "completed_at"])


def run_durations(runs: DataFrame, as_of) -> DataFrame:
    end = F.coalesce(F.col("completed_at"), F.lit(as_of).cast("timestamp_ntz"))
    return runs.select("pipeline_run_id", "status", F.timestamp_diff("SECOND", F.col("started_at"), end).alias("duration_s"))


def run_outcomes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def task_event_trace(task_events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Task events of ``runs`` (all without them) with ``step``, their place within the run in diagnostic order (task,
    attempt, type, time). A run's events meet in one task, the table as a whole is never sorted."""
    if runs is not None:
        task_events = task_events.join(runs.select("pipeline_run_id").distinct(), "pipeline_run_id", "left_semi")
    order = Window.partitionBy("pipeline_run_id").orderBy("task_id", "attempt", "event_type", "event_time")
    return task_events.withColumn("step", F.row_number().over(order))


def lookup_first(df: DataFrame, keys: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per looked-up key: semi join to the key set, then one row per key."""
    hit = df.join(keys.select(key).distinct(), key, "left_semi")
    return latest_by(hit, [key], order, [c for c in df.columns if c != key])


def partitions_for(n_rows: int) -> int:
    return max(1 + n_rows // MOST_PER_TASK, min(1 + n_rows // ROWS_PER_TASK, UNBUFFERED))


def telemetry_gaps(runs: DataFrame, task_events: DataFrame, expected_tasks: list[str]) -> DataFrame:
    """Per terminal run: expected tasks without a terminal event, and started
    tasks that never reached one.

    Expected tasks and events meet in one aggregate per (run, task), dealt over as many partitions as the rows ask for,
    so that what a task holds does not grow with the tables. A run or task that is NULL matches nothing."""
    keys = ["pipeline_run_id", "task_id"]
    started, ended = F.col("event_type") == "STARTED", F.col("event_type").isin(*TERMINAL)
    events = task_events.filter(started | ended).select(*keys, started.alias("started"), ended.alias("ended"), F.lit(0).alias("expected"))
    done = runs.filter(F.col("status").isin("SUCCESS", "FAILED"))
    expected = done.select("pipeline_run_id", F.explode(F.array(*[F.lit(t) for t in expected_tasks])).alias("task_id")).select(
        *keys, F.lit(False).alias("started"), F.lit(False).alias("ended"), F.lit(1).alias("expected")
    )
    n_rows = task_events.count() + len(expected_tasks) * runs.count()
    seen = (
        events.unionByName(expected)
        .repartition(partitions_for(n_rows), *keys)
        .groupBy(*keys)
        .agg(F.bool_or("started").alias("started"), F.bool_or("ended").alias("ended"), F.sum("expected").cast("int").alias("expected"))
    )
    unmatched = ~F.col("ended") | F.col("pipeline_run_id").isNull() | F.col("task_id").isNull()
    gaps = F.concat(
        F.array_repeat(F.lit("missing_terminal"), F.col("expected")),
        F.array_repeat(F.lit("started_not_terminal"), F.col("started").cast("int")),
    )
    return seen.filter(unmatched).select(*keys, F.explode(gaps).alias("gap_type"))


def upstream_failed_rows(runs: DataFrame, task_events: DataFrame, expected_tasks: list[str]) -> DataFrame:
    """FAILED run -> one UPSTREAM_FAILED event per expected task with no terminal event."""
    failed = runs.filter(F.col("status") == "FAILED")
    gaps = telemetry_gaps(failed, task_events, expected_tasks).filter(F.col("gap_type") == "missing_terminal")
    return gaps.select(
        "pipeline_run_id", "task_id", F.lit(1).cast("bigint").alias("attempt"), F.lit("UPSTREAM_FAILED").alias("event_type")
    )


def task_timing(task_events: DataFrame, as_of) -> DataFrame:
    """Per (run, task): exact / partial (no end: bounded by as_of) / none (no start)."""
    g = task_events.groupBy("pipeline_run_id", "task_id").agg(
        F.min(F.when(F.col("event_type") == "STARTED", F.col("event_time"))).alias("started_at"),
        F.max(F.when(F.col("event_type").isin(*TERMINAL), F.col("event_time"))).alias("ended_at"),
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    no_start = F.col("started_at").isNull()
    end = F.coalesce(F.col("ended_at"), now)
    ms = F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("MILLISECOND", F.col("started_at"), end))
    return g.select(
        "pipeline_run_id",
        "task_id",
        F.when(no_start, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("started_at")).alias("started_at"),
        F.when(no_start, F.lit(None).cast("timestamp_ntz")).otherwise(end).alias("ended_at"),
        F.when(no_start, F.lit(None).cast("bigint")).otherwise(ms).alias("duration_ms"),
        F.when(no_start, "none").when(F.col("ended_at").isNull(), "partial").otherwise("exact").alias("timing_confidence"),
    )


# Fixed value: days that a backfill may cover without an override.
MAX_BACKFILL_DAYS = 7


def backfill_days(start: str, end: str, max_days: int = MAX_BACKFILL_DAYS, override: bool = False) -> int:
    """Days of a backfill window, which may pass ``max_days`` only with an explicit override."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if last < first:
        raise ValueError("end date precedes start date")
    days = (last - first).days + 1
    if days > max_days and override is not True:
        raise ValueError(f"a backfill of {days} days is above the limit of {max_days} and needs an override")
    return days


def backfill_calendar(
    loaded_dates: DataFrame, start: str, end: str, date_col: str = "event_date", max_days: int = MAX_BACKFILL_DAYS, override: bool = False
) -> DataFrame:
    """Calendar days in [start, end] with no loaded data (anti join to the
    distinct loaded dates). Windows above ``max_days`` need an override."""
    backfill_days(start, end, max_days, override)
    spark = loaded_dates.sparkSession
    cal = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("missing_date")
    )
    have = loaded_dates.select(F.col(date_col).alias("missing_date")).distinct()
    return cal.join(have, "missing_date", "left_anti")


def ledger_latest(ledger: DataFrame) -> DataFrame:
    """Latest ledger row per migration (``max_by`` over applied_at, then seq)."""
    return latest_by(ledger, ["migration_id"], ["applied_at", "seq"], ["migration_checksum", "status", "applied_at"])


def migration_plan(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifest (migration_id, checksum) left join latest ledger state: PENDING
    (no ledger row) / FAILED_PREVIOUSLY (any state but APPLIED, a missing one
    too) / CHECKSUM_MISMATCH / APPLIED."""
    latest = ledger_latest(ledger).withColumn("_found", F.lit(True))
    j = manifest.join(latest, "migration_id", "left")
    return j.select(
        "migration_id",
        F.when(F.col("_found").isNull(), "PENDING")
        .when(~F.col("status").eqNullSafe(F.lit("APPLIED")), "FAILED_PREVIOUSLY")
        .when(F.col("migration_checksum") != F.col("checksum"), "CHECKSUM_MISMATCH")
        .otherwise("APPLIED")
        .alias("plan_state"),
    )

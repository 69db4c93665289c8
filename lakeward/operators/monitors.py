"""Operational monitors: each check is one aggregation over an ops table that
yields exactly one result row ``(check_name, status, severity, observed_value,
threshold)``; ``monitor_all`` unions them into one plan.

``as_of`` is the evaluation instant (never ``current_timestamp()`` inside a
testable check). "Latest row" is a ``max_by`` over a total order (time, then
id), so it is a partial aggregation rather than a sort.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the monitor configuration by section.
THRESHOLDS = {
    "missing_run": {"grace_seconds": 7200},
    "freshness": {"warn_seconds": 93600, "fail_seconds": 180000},
    "volume": {"baseline_window_runs": 7, "warn_deviation": 0.50, "fail_deviation": 0.80, "min_baseline_rows": 1000},
    "rejection_rate": {"warn": 0.20, "fail": 0.35},
    "telemetry": {"window_hours": 48},
    "reconciliation": {"window_hours": 48},
    "deployment": {"window_hours": 168},
    "cost": {"window_hours": 24, "baseline_window_days": 7, "warn_ratio": 3.0, "fail_ratio": 10.0,
             "min_bytes_billed": 1073741824},
}
TERMINAL_TASK_EVENTS = ["SUCCESS", "FAILED", "SKIPPED", "UPSTREAM_FAILED"]
STATUS_GAUGE = {"PASS": 0, "WARN": 1, "FAIL": 2, "NO_DATA": -1, "DISABLED": -2}
RESULT_COLUMNS = ["check_name", "status", "severity", "observed_value", "threshold"]
RESULT_SCHEMA = "check_name string, status string, severity string, observed_value double, threshold double, details string"
# The gauges published beside a check's status, from its observed value.
EXTRA_METRICS = {
    "latest_run_state": "pipeline/run_duration_seconds",
    "freshness": "pipeline/last_success_age_seconds",
    "telemetry_completeness": "pipeline/telemetry_incomplete_count",
    "reconciliation": "data/reconciliation_failure_count",
    "volume_deviation": "data/volume_deviation_ratio",
    "rejection_rate": "data/rejection_rate",
    "deployment_failure": "deployment/latest_failed",
}
# A volume without a baseline is published as it is.
VOLUME_WITHOUT_BASELINE = "data/raw_row_count"


def thresholds(overrides: DataFrame | None = None) -> dict[str, dict[str, float]]:
    """The thresholds, with rows (section, name, value) of ``overrides`` put in their place.

    Unknown sections or names are refused, so a misspelt override cannot pass for one; of several rows the largest value
    counts. At most one row per threshold reaches the driver."""
    found = {k: dict(v) for k, v in THRESHOLDS.items()}
    if overrides is None:
        return found
    known = [(s, n) for s, v in THRESHOLDS.items() for n in v]
    names = overrides.sparkSession.createDataFrame(known, "section string, name string")
    strange = overrides.join(names, ["section", "name"], "left_anti").select("section", "name").first()
    if strange:
        raise ValueError(f"no threshold {strange['section']}.{strange['name']}")
    rows = overrides.join(names, ["section", "name"]).groupBy("section", "name").agg(F.max("value").alias("value"))
    for r in rows.collect():
        kind = type(THRESHOLDS[r["section"]][r["name"]])
        found[r["section"]][r["name"]] = kind(r["value"])
    return found


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def _since(as_of, hours: int = 0, days: int = 0) -> Column:
    return _ts(as_of) - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def _secs(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def _result(df: DataFrame, name: str, status: Column, severity: Column, observed: Column, threshold: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check_name"),
        status.alias("status"),
        severity.alias("severity"),
        observed.cast("double").alias("observed_value"),
        threshold.cast("double").alias("threshold"),
    )


def _graded(value: Column, warn: float, fail: float):
    status = F.when(value >= fail, "FAIL").when(value >= warn, "WARN").otherwise("PASS")
    severity = F.when(status == "FAIL", "CRITICAL").when(status == "WARN", "WARNING").otherwise("INFO")
    threshold = F.when(status == "FAIL", F.lit(fail)).otherwise(F.lit(warn))
    return status, severity, threshold


def _latest(order: list[str], values: list[str]) -> Column:
    return F.max_by(F.struct(*values), F.struct(*order))


def _nd():
    return F.lit(None).cast("double")


def latest_run_state(runs: DataFrame, as_of, window_hours: int = 48) -> DataFrame:
    l = runs.filter(F.col("started_at") >= _since(as_of, hours=window_hours)).agg(
        _latest(["started_at", "pipeline_run_id"], ["status", "started_at", "completed_at"]).alias("l")
    )
    dur = F.coalesce(_secs(F.col("l.started_at"), F.coalesce(F.col("l.completed_at"), _ts(as_of))), F.lit(0))
    none = F.col("l").isNull()
    status = (
        F.when(none, "NO_DATA").when(F.col("l.status") == "FAILED", "FAIL").when(F.col("l.status") == "RUNNING", "WARN").otherwise("PASS")
    )
    sev = F.when(F.col("l.status") == "FAILED", "CRITICAL").otherwise("INFO")
    return _result(l, "latest_run_state", status, sev, F.when(none, _nd()).otherwise(dur), _nd())


def freshness(runs: DataFrame, as_of, warn_seconds: int = 93600, fail_seconds: int = 180000) -> DataFrame:
    a = runs.filter((F.col("status") == "SUCCESS") & (F.col("completed_at") >= _since(as_of, days=30))).agg(
        _secs(F.max("completed_at"), _ts(as_of)).alias("age")
    )
    st, sev, th = _graded(F.col("age"), warn_seconds, fail_seconds)
    none = F.col("age").isNull()
    return _result(
        a, "freshness", F.when(none, "NO_DATA").otherwise(st), F.when(none, "INFO").otherwise(sev),
        F.col("age"), F.when(none, _nd()).otherwise(th),
    )


def missing_scheduled_run(runs: DataFrame, as_of, grace_seconds: int = 7200) -> DataFrame:
    limit = 86400 + grace_seconds
    a = runs.filter(F.col("started_at") >= _since(as_of, days=30)).agg(
        _secs(F.max("started_at"), _ts(as_of)).alias("since")
    )
    none = F.col("since").isNull()
    fail = F.col("since") > limit  # strict, unlike the other monitors
    return _result(
        a, "missing_scheduled_run",
        F.when(none, "NO_DATA").when(fail, "FAIL").otherwise("PASS"),
        F.when(none, "INFO").when(fail, "WARNING").otherwise("INFO"),
        F.col("since"), F.when(none, _nd()).otherwise(F.lit(float(limit))),
    )


def telemetry_completeness(
    runs: DataFrame, task_events: DataFrame, as_of, expected_tasks: int, window_hours: int = 48
) -> DataFrame:
    """Missing terminal tasks of the newest terminal run (any terminal task id
    counts). The one latest run id is joined back (a one-row broadcast)."""
    latest = runs.filter(
        (F.col("started_at") >= _since(as_of, hours=window_hours)) & F.col("status").isin("SUCCESS", "FAILED")
    ).agg(_latest(["started_at", "pipeline_run_id"], ["pipeline_run_id"]).alias("l")).select(
        F.col("l.pipeline_run_id").alias("pipeline_run_id")
    )
    terminal = (
        task_events.filter(F.col("event_type").isin(*TERMINAL_TASK_EVENTS))
        .join(F.broadcast(latest.filter(F.col("pipeline_run_id").isNotNull())), "pipeline_run_id", "left_semi")
        .agg(F.countDistinct("task_id").alias("n"))
    )
    a = latest.withColumn("k", F.lit(1)).join(terminal.withColumn("k", F.lit(1)), "k")
    none = F.col("pipeline_run_id").isNull()
    missing = F.greatest(F.lit(0), F.lit(expected_tasks) - F.col("n"))
    return _result(
        a, "telemetry_completeness",
        F.when(none, "NO_DATA").when(missing > 0, "FAIL").otherwise("PASS"),
        F.when(~none & (missing > 0), "WARNING").otherwise("INFO"),
        F.when(none, _nd()).otherwise(missing), F.when(none, _nd()).otherwise(F.lit(0.0)),
    )


def reconciliation(quality_results: DataFrame, as_of, window_hours: int = 48, recent: DataFrame | None = None) -> DataFrame:
    """Failed checks of the run evaluated last. ``recent``: the results of the window, where a narrower scan has them."""
    latest = (quality_results if recent is None else recent).filter(F.col("evaluated_at") >= _since(as_of, hours=window_hours)).agg(
        _latest(["evaluated_at", "pipeline_run_id"], ["pipeline_run_id"]).alias("l")
    ).select(F.col("l.pipeline_run_id").alias("pipeline_run_id"))
    failed = (
        quality_results.join(F.broadcast(latest.filter(F.col("pipeline_run_id").isNotNull())), "pipeline_run_id", "left_semi")
        .agg(F.count_if(F.col("status") == "FAIL").alias("failed"))
    )
    a = latest.withColumn("k", F.lit(1)).join(failed.withColumn("k", F.lit(1)), "k")
    none = F.col("pipeline_run_id").isNull()
    return _result(
        a, "reconciliation",
        F.when(none, "NO_DATA").when(F.col("failed") > 0, "FAIL").otherwise("PASS"),
        F.when(~none & (F.col("failed") > 0), "CRITICAL").otherwise("INFO"),
        F.when(none, _nd()).otherwise(F.col("failed")), F.when(none, _nd()).otherwise(F.lit(0.0)),
    )


def volume_deviation(runs: DataFrame, as_of, n: int = 7, warn: float = 0.5, fail: float = 0.8, min_baseline: int = 1000) -> DataFrame:
    """Latest successful volume vs the element median of the n runs before it.

    The n+1 newest runs are taken with a distributed top-k (``orderBy.limit``);
    only those n+1 rows reach the single-partition window."""
    recent = (
        runs.filter(
            (F.col("status") == "SUCCESS") & F.col("rows_loaded").isNotNull() & (F.col("started_at") >= _since(as_of, days=30))
        )
        .select("rows_loaded", "started_at", "pipeline_run_id")
        .orderBy(F.col("started_at").desc(), F.col("pipeline_run_id").desc())
        .limit(n + 1)
    )
    a = recent.agg(
        F.max_by("rows_loaded", F.struct("started_at", "pipeline_run_id")).alias("latest"),
        F.collect_list(F.struct("started_at", "pipeline_run_id", "rows_loaded")).alias("all"),
    )
    # baseline = lower-middle element of the n previous runs (element median)
    prev = F.slice(F.sort_array(F.col("all"), asc=False), 2, n)
    vals = F.sort_array(F.transform(prev, lambda x: x["rows_loaded"]))
    k = F.size(vals)
    baseline = F.when(k > 0, F.element_at(vals, ((k + 1) / 2).cast("int")))
    a = a.select("latest", baseline.alias("baseline"))
    ratio = F.col("latest") / F.col("baseline")
    dev = F.abs(F.lit(1.0) - ratio)
    st, sev, th = _graded(dev, warn, fail)
    no_latest = F.col("latest").isNull()
    no_base = F.col("baseline").isNull() | (F.col("baseline") < min_baseline)
    return _result(
        a, "volume_deviation",
        F.when(no_latest | no_base, "NO_DATA").otherwise(st),
        F.when(no_latest | no_base, "INFO").otherwise(sev),
        F.when(no_latest, _nd()).when(no_base, F.col("latest")).otherwise(ratio),
        F.when(no_latest | no_base, _nd()).otherwise(th),
    )


def rejection_rate(runs: DataFrame, as_of, warn: float = 0.20, fail: float = 0.35) -> DataFrame:
    a = runs.filter(
        (F.col("status") == "SUCCESS") & F.col("rows_loaded").isNotNull() & F.col("rows_rejected").isNotNull()
        & (F.col("started_at") >= _since(as_of, days=30))
    ).agg(_latest(["started_at", "pipeline_run_id"], ["rows_loaded", "rows_rejected"]).alias("l"))
    none = F.col("l").isNull() | F.coalesce(F.col("l.rows_loaded") == 0, F.lit(True))
    rate = F.col("l.rows_rejected") / F.col("l.rows_loaded")
    st, sev, th = _graded(rate, warn, fail)
    return _result(
        a, "rejection_rate", F.when(none, "NO_DATA").otherwise(st), F.when(none, "INFO").otherwise(sev),
        F.when(none, _nd()).otherwise(rate), F.when(none, _nd()).otherwise(th),
    )


def deployment_failure(deployments: DataFrame, as_of, window_hours: int = 168, rollback_only: bool = False) -> DataFrame:
    d = deployments.filter(F.col("started_at") >= _since(as_of, hours=window_hours))
    if rollback_only:
        d = d.filter(F.col("deployment_type") == "rollback")
    a = d.agg(_latest(["started_at", "deployment_id"], ["status"]).alias("l"))
    none = F.col("l").isNull()
    bad = ["ROLLBACK_FAILED"] if rollback_only else ["FAILED", "ROLLBACK_FAILED"]
    failed = F.col("l.status").isin(*bad)
    name = "rollback_failure" if rollback_only else "deployment_failure"
    return _result(
        a, name,
        F.when(none, "NO_DATA").when(failed, "FAIL").otherwise("PASS"),
        F.when(~none & failed, "CRITICAL").otherwise("INFO"),
        F.when(none, _nd()).when(failed, F.lit(1.0)).otherwise(F.lit(0.0)),
        F.when(none, _nd()).otherwise(F.lit(0.0)),
    )


def has_label(labels: str | Column, key: str, value: str) -> Column:
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.exists(c, lambda l: (l["key"] == key) & (l["value"] == value)), F.lit(False))


def cost_anomaly(
    jobs: DataFrame, as_of, app_label=("application", "events-platform"), window_hours: int = 24,
    baseline_days: int = 7, warn: float = 3.0, fail: float = 10.0, min_bytes: int = 1073741824,
) -> DataFrame:
    cut = _since(as_of, hours=window_hours)
    a = jobs.filter(
        (F.col("creation_time") >= _since(as_of, days=baseline_days + 1))
        & has_label("labels", *app_label)
        & (F.col("statement_type") != "SCRIPT")
    ).agg(
        F.coalesce(F.sum(F.when(F.col("creation_time") >= cut, F.col("total_bytes_billed")).otherwise(0)), F.lit(0)).alias("wb"),
        (F.coalesce(F.sum(F.when(F.col("creation_time") < cut, F.col("total_bytes_billed")).otherwise(0)), F.lit(0)) / baseline_days).alias("base"),
    )
    ratio = F.col("wb") / F.col("base")
    st, sev, th = _graded(ratio, warn, fail)
    below = F.col("wb") < min_bytes
    nobase = F.col("base") <= 0
    return _result(
        a, "cost_anomaly",
        F.when(below, "PASS").when(nobase, "NO_DATA").otherwise(st),
        F.when(below | nobase, "INFO").otherwise(sev),
        F.when(below | nobase, F.col("wb")).otherwise(ratio),
        F.when(below | nobase, _nd()).otherwise(th),
    )


def _unknown(name: str, error: Exception) -> tuple:
    text = str(error).strip().splitlines()[0][:300] if str(error).strip() else ""
    return (name, "NO_DATA", "WARNING", None, None, json.dumps({"error_type": type(error).__name__, "error": text}))


def monitor_all(checks: dict[str, callable], enabled: bool = True, results_path: str | None = None, as_of=None) -> DataFrame:
    """One row per check, ``RESULT_SCHEMA``; evaluated here, one row a check reaches the driver.

    All checks run as one plan. If that fails, in analysis or while running, each check is evaluated apart, and one
    that fails becomes NO_DATA with its reason in ``details`` while the others keep their verdicts. Disabled checks are
    not evaluated. With ``results_path`` the evaluations are appended there, with an id and ``as_of``."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    built, rows = {}, {}
    for name, build in checks.items():
        if not enabled:
            rows[name] = (name, "DISABLED", "INFO", None, None, None)
            continue
        try:
            built[name] = build().select(*RESULT_COLUMNS)
        except Exception as e:  # noqa: BLE001 - one broken check must not hide the rest
            rows[name] = _unknown(name, e)
    try:
        for r in reduce(DataFrame.unionByName, built.values()).collect() if built else []:
            rows[r["check_name"]] = (*r, None)
    except Exception:  # noqa: BLE001 - find the one that failed
        for name, df in built.items():
            try:
                rows[name] = (*df.first(), None)
            except Exception as e:  # noqa: BLE001
                rows[name] = _unknown(name, e)
    results = spark.createDataFrame([rows[n] for n in checks if n in rows], RESULT_SCHEMA)
    if results_path:
        now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else _ts(as_of)
        results.select(
            F.concat_ws("-", "check_name", F.lit(uuid.uuid4().hex[:12])).alias("evaluation_id"), "*", now.alias("evaluated_at")
        ).write.mode("append").parquet(results_path)
    return results


def monitor_metrics(results: DataFrame, environment: str = "dev", mode: str = "normal") -> DataFrame:
    """Gauge points: every check's status as a number, and the observed value of those checks that publish one.

    All carry ``environment`` and ``mode``; status points name their check."""
    status = F.create_map(*[x for k, v in STATUS_GAUGE.items() for x in (F.lit(k), F.lit(v))])
    extra = F.create_map(*[x for k, v in EXTRA_METRICS.items() for x in (F.lit(k), F.lit(v))])
    unbased = (F.col("check_name") == "volume_deviation") & (F.col("status") == "NO_DATA")
    base = [F.lit("environment"), F.lit(environment), F.lit("mode"), F.lit(mode)]
    own = F.struct(
        F.lit("monitor/check_status").alias("metric_type"),
        F.create_map(*base, F.lit("check_name"), F.col("check_name")).alias("labels"),
        status[F.col("status")].cast("double").alias("value"),
    )
    name = F.when(unbased, F.lit(VOLUME_WITHOUT_BASELINE)).otherwise(extra[F.col("check_name")])
    more = F.when(
        name.isNotNull() & F.col("observed_value").isNotNull(),
        F.struct(name.alias("metric_type"), F.create_map(*base).alias("labels"), F.col("observed_value").alias("value")),
    )
    return results.select(F.inline(F.array_compact(F.array(own, more))))

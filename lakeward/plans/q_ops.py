"""Registered queries: operational monitors, cost attribution, ops lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeward.operators import costs, monitors, ops
from lakeward.plans.registry import query
from lakeward.sources import adapters as ad
from lakeward.sources.tables import read_table

RUNS_AS_OF = dt.datetime(2001, 8, 2)
JOBS_AS_OF = dt.datetime(2001, 11, 5)
EXPECTED_TASKS = ["task_1", "task_2", "task_3"]


def runs(spark, d, since=None):
    return ad.pipeline_runs_from_orders(read_table(spark, d, "orders"), since)


def deployments(spark, d, since=None):
    return ad.deployments_from_orders(read_table(spark, d, "orders"), since)


def task_events(spark, d):
    return ad.task_events_from_lineitem(read_table(spark, d, "lineitem"))


def quality(spark, d, since=None):
    return ad.quality_results_from_lineitem(read_table(spark, d, "lineitem"), since)


def jobs(spark, d, since=None):
    return ad.job_history_from_lineitem(read_table(spark, d, "lineitem"), since)


# ----------------------------------------------------------------- oracle CTEs
O_RUNS = """runs AS (
  SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS pipeline_run_id,
    'b-' || strftime(o_orderdate, '%Y%m%d') AS batch_id,
    CAST(o_orderdate AS DATE) AS processing_date,
    o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + to_seconds(o_orderkey % 86400)
         + to_seconds(300 + o_orderkey % 3300) END AS completed_at,
    CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'RUNNING' END AS status,
    CAST(1 + o_orderkey % 2 AS BIGINT) AS attempt_number,
    CAST(floor(o_totalprice) AS BIGINT) AS rows_loaded,
    CAST(floor(o_totalprice) AS BIGINT) - (CAST(floor(o_totalprice) AS BIGINT) * (o_custkey % 40)) // 100 AS rows_accepted,
    (CAST(floor(o_totalprice) AS BIGINT) * (o_custkey % 40)) // 100 AS rows_rejected,
    'env-' || CAST(o_custkey % 3 AS VARCHAR) AS environment
  FROM orders)"""
O_DEPLOY = """deployments AS (
  SELECT 'dep-' || CAST(o_orderkey AS VARCHAR) AS deployment_id,
    CASE WHEN o_orderkey % 5 = 0 THEN 'rollback' ELSE 'release' END AS deployment_type,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'F' THEN 'ROLLBACK_FAILED'
         WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'O' THEN 'ROLLED_BACK'
         WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'SUCCESS' ELSE 'RUNNING' END AS status,
    substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS git_sha,
    o_orderdate + INTERVAL 6 HOUR + to_seconds(o_orderkey % 3600) AS started_at,
    CASE WHEN o_orderstatus = 'P' THEN NULL
         ELSE o_orderdate + INTERVAL 6 HOUR + to_seconds(o_orderkey % 3600) + INTERVAL 600 SECOND END AS completed_at,
    CAST(o_orderkey % 4 AS BIGINT) AS migration_count,
    'env-' || CAST(o_custkey % 3 AS VARCHAR) AS environment
  FROM orders)"""
O_TASKS = """task_events AS (
  SELECT 'run-' || CAST(l_orderkey AS VARCHAR) AS pipeline_run_id, 'task_' || CAST(l_linenumber AS VARCHAR) AS task_id,
    CAST(1 AS BIGINT) AS attempt,
    CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'SUCCESS' ELSE 'STARTED' END AS event_type,
    l_shipdate AS event_time
  FROM lineitem)"""
O_QUALITY = """quality_results AS (
  SELECT 'run-' || CAST(l_orderkey AS VARCHAR) AS pipeline_run_id, 'check_' || CAST(l_linenumber AS VARCHAR) AS check_name,
    CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'PASS' ELSE 'WARN' END AS status,
    l_quantity AS observed_value, l_shipdate + to_hours(l_linenumber) AS evaluated_at
  FROM lineitem)"""
O_JOBS = """jobs AS (
  SELECT l_shipdate + to_hours(l_linenumber) + to_seconds(l_partkey % 3600) AS creation_time,
    'job-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS job_id,
    'QUERY' AS job_type,
    CASE WHEN l_suppkey % 4 = 0 THEN 'pipeline-runtime@example.iam'
         ELSE 'analyst-' || CAST(l_suppkey % 4 AS VARCHAR) || '@example.com' END AS user_email,
    CASE l_linenumber WHEN 1 THEN 'SCRIPT' WHEN 2 THEN 'INSERT' ELSE 'SELECT' END AS statement_type,
    CAST(floor(l_extendedprice * 100000) AS BIGINT) AS total_bytes_processed,
    CAST(floor(l_extendedprice * 100000) AS BIGINT) AS total_bytes_billed,
    CAST(l_quantity * 100 AS BIGINT) AS total_slot_ms,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE [
      {'key': 'application', 'value': CASE WHEN l_linestatus = 'O' THEN 'events-platform' ELSE 'other' END},
      {'key': 'component', 'value': l_returnflag}] END AS labels,
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0
         THEN {'reason': CASE WHEN l_partkey % 2 = 0 THEN 'invalidQuery' ELSE 'rateLimitExceeded' END} END AS error_result,
    coalesce(len(list_filter(CASE WHEN l_linenumber = 7 THEN NULL ELSE [
      {'key': 'application', 'value': CASE WHEN l_linestatus = 'O' THEN 'events-platform' ELSE 'other' END}] END,
      lambda x: x.key = 'application' AND x.value = 'events-platform')) > 0, false) AS is_app
  FROM lineitem)"""

RA = "TIMESTAMP '2001-08-02 00:00:00'"
JA = "TIMESTAMP '2001-11-05 00:00:00'"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def grade(v: str, warn, fail) -> str:
    return (
        f"CASE WHEN {v} >= {fail} THEN 'FAIL' WHEN {v} >= {warn} THEN 'WARN' ELSE 'PASS' END",
        f"CASE WHEN {v} >= {fail} THEN 'CRITICAL' WHEN {v} >= {warn} THEN 'WARNING' ELSE 'INFO' END",
        f"CASE WHEN {v} >= {fail} THEN {float(fail)} ELSE {float(warn)} END",
    )


MON_LATEST = f"""SELECT 'latest_run_state' AS check_name,
  CASE WHEN l.status IS NULL THEN 'NO_DATA' WHEN l.status = 'FAILED' THEN 'FAIL' WHEN l.status = 'RUNNING' THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN l.status = 'FAILED' THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CAST(CASE WHEN l.status IS NULL THEN NULL ELSE coalesce(date_sub('second', l.started_at, coalesce(l.completed_at, {RA})), 0) END AS DOUBLE) AS observed_value,
  CAST(NULL AS DOUBLE) AS threshold
FROM (SELECT 1) d LEFT JOIN (SELECT * FROM runs WHERE started_at >= {RA} - INTERVAL 48 HOUR
  ORDER BY started_at DESC, pipeline_run_id DESC LIMIT 1) l ON true"""

_fs, _fv, _ft = grade("age", 93600, 180000)
MON_FRESH = f"""SELECT 'freshness' AS check_name,
  CASE WHEN age IS NULL THEN 'NO_DATA' ELSE {_fs} END AS status,
  CASE WHEN age IS NULL THEN 'INFO' ELSE {_fv} END AS severity,
  CAST(age AS DOUBLE) AS observed_value, CASE WHEN age IS NULL THEN NULL ELSE {_ft} END AS threshold
FROM (SELECT date_sub('second', max(completed_at), {RA}) AS age FROM runs
      WHERE status = 'SUCCESS' AND completed_at >= {RA} - INTERVAL 30 DAY)"""

MON_MISSING = f"""SELECT 'missing_scheduled_run' AS check_name,
  CASE WHEN since IS NULL THEN 'NO_DATA' WHEN since > 93600 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN since > 93600 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CAST(since AS DOUBLE) AS observed_value, CASE WHEN since IS NULL THEN NULL ELSE 93600.0 END AS threshold
FROM (SELECT date_sub('second', max(started_at), {RA}) AS since FROM runs WHERE started_at >= {RA} - INTERVAL 30 DAY)"""

MON_TELEMETRY = f"""SELECT 'telemetry_completeness' AS check_name,
  CASE WHEN l.pipeline_run_id IS NULL THEN 'NO_DATA' WHEN greatest(0, 3 - n) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN l.pipeline_run_id IS NOT NULL AND greatest(0, 3 - n) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CAST(CASE WHEN l.pipeline_run_id IS NULL THEN NULL ELSE greatest(0, 3 - n) END AS DOUBLE) AS observed_value,
  CASE WHEN l.pipeline_run_id IS NULL THEN NULL ELSE 0.0 END AS threshold
FROM (SELECT 1) d
LEFT JOIN (SELECT pipeline_run_id FROM runs WHERE started_at >= {RA} - INTERVAL 48 HOUR AND status IN ('SUCCESS', 'FAILED')
           ORDER BY started_at DESC, pipeline_run_id DESC LIMIT 1) l ON true
LEFT JOIN LATERAL (SELECT count(DISTINCT task_id) AS n FROM task_events t
   WHERE t.pipeline_run_id = l.pipeline_run_id AND event_type IN ('SUCCESS','FAILED','SKIPPED','UPSTREAM_FAILED')) c ON true"""

MON_RECON = f"""SELECT 'reconciliation' AS check_name,
  CASE WHEN l.pipeline_run_id IS NULL THEN 'NO_DATA' WHEN failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN l.pipeline_run_id IS NOT NULL AND failed > 0 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CAST(CASE WHEN l.pipeline_run_id IS NULL THEN NULL ELSE failed END AS DOUBLE) AS observed_value,
  CASE WHEN l.pipeline_run_id IS NULL THEN NULL ELSE 0.0 END AS threshold
FROM (SELECT 1) d
LEFT JOIN (SELECT pipeline_run_id FROM quality_results WHERE evaluated_at >= {JA} - INTERVAL 48 HOUR
           ORDER BY evaluated_at DESC, pipeline_run_id DESC LIMIT 1) l ON true
LEFT JOIN LATERAL (SELECT count_if(status = 'FAIL') AS failed FROM quality_results q
                   WHERE q.pipeline_run_id = l.pipeline_run_id) c ON true"""

_vs, _vv, _vt = grade("abs(1.0 - latest / baseline)", 0.5, 0.8)
MON_VOLUME = f"""SELECT 'volume_deviation' AS check_name,
  CASE WHEN latest IS NULL OR baseline IS NULL OR baseline < 1000 THEN 'NO_DATA' ELSE {_vs} END AS status,
  CASE WHEN latest IS NULL OR baseline IS NULL OR baseline < 1000 THEN 'INFO' ELSE {_vv} END AS severity,
  CAST(CASE WHEN latest IS NULL THEN NULL WHEN baseline IS NULL OR baseline < 1000 THEN latest
       ELSE latest / baseline END AS DOUBLE) AS observed_value,
  CASE WHEN latest IS NULL OR baseline IS NULL OR baseline < 1000 THEN NULL ELSE {_vt} END AS threshold
FROM (
  SELECT (SELECT rows_loaded FROM recent WHERE rn = 1) AS latest,
         (SELECT quantile_disc(rows_loaded, 0.5) FROM recent WHERE rn > 1) AS baseline
) x"""
O_RECENT = f"""recent AS (
  SELECT rows_loaded, row_number() OVER (ORDER BY started_at DESC, pipeline_run_id DESC) AS rn
  FROM runs WHERE status = 'SUCCESS' AND rows_loaded IS NOT NULL AND started_at >= {RA} - INTERVAL 30 DAY
  QUALIFY rn <= 8)"""

_rs, _rv, _rt = grade("rate", 0.20, 0.35)
MON_REJECT = f"""SELECT 'rejection_rate' AS check_name,
  CASE WHEN coalesce(loaded, 0) = 0 THEN 'NO_DATA' ELSE {_rs} END AS status,
  CASE WHEN coalesce(loaded, 0) = 0 THEN 'INFO' ELSE {_rv} END AS severity,
  CASE WHEN coalesce(loaded, 0) = 0 THEN NULL ELSE rate END AS observed_value,
  CASE WHEN coalesce(loaded, 0) = 0 THEN NULL ELSE {_rt} END AS threshold
FROM (SELECT 1) d LEFT JOIN (SELECT rows_loaded AS loaded, CAST(rows_rejected AS DOUBLE) / rows_loaded AS rate FROM runs
  WHERE status = 'SUCCESS' AND rows_loaded IS NOT NULL AND rows_rejected IS NOT NULL AND started_at >= {RA} - INTERVAL 30 DAY
  ORDER BY started_at DESC, pipeline_run_id DESC LIMIT 1) l ON true"""


def mon_deploy_sql(rollback_only: bool) -> str:
    name = "rollback_failure" if rollback_only else "deployment_failure"
    bad = "('ROLLBACK_FAILED')" if rollback_only else "('FAILED', 'ROLLBACK_FAILED')"
    extra = "AND deployment_type = 'rollback'" if rollback_only else ""
    return f"""SELECT '{name}' AS check_name,
  CASE WHEN l.status IS NULL THEN 'NO_DATA' WHEN l.status IN {bad} THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN l.status IN {bad} THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CASE WHEN l.status IS NULL THEN NULL WHEN l.status IN {bad} THEN 1.0 ELSE 0.0 END AS observed_value,
  CASE WHEN l.status IS NULL THEN NULL ELSE 0.0 END AS threshold
FROM (SELECT 1) d LEFT JOIN (SELECT status FROM deployments WHERE started_at >= {RA} - INTERVAL 168 HOUR {extra}
  ORDER BY started_at DESC, deployment_id DESC LIMIT 1) l ON true"""


_cs, _cv, _ct = grade("wb / base", 3.0, 10.0)
MON_COST = f"""SELECT 'cost_anomaly' AS check_name,
  CASE WHEN wb < 1073741824 THEN 'PASS' WHEN base <= 0 THEN 'NO_DATA' ELSE {_cs} END AS status,
  CASE WHEN wb < 1073741824 OR base <= 0 THEN 'INFO' ELSE {_cv} END AS severity,
  CAST(CASE WHEN wb < 1073741824 OR base <= 0 THEN wb ELSE wb / base END AS DOUBLE) AS observed_value,
  CASE WHEN wb < 1073741824 OR base <= 0 THEN NULL ELSE {_ct} END AS threshold
FROM (SELECT coalesce(sum(CASE WHEN creation_time >= {JA} - INTERVAL 24 HOUR THEN total_bytes_billed ELSE 0 END), 0) AS wb,
             coalesce(sum(CASE WHEN creation_time < {JA} - INTERVAL 24 HOUR THEN total_bytes_billed ELSE 0 END), 0) / 7 AS base
      FROM jobs WHERE creation_time >= {JA} - INTERVAL 8 DAY AND is_app AND statement_type != 'SCRIPT')"""


def _checks(spark, d, t=None):
    """Every check as a function that builds its plan, each on a scan bounded by the window it looks at."""
    t = t or monitors.thresholds()
    ago = lambda as_of, **k: as_of - dt.timedelta(**k)
    month = runs(spark, d, ago(RUNS_AS_OF, days=31))
    deployed = deployments(spark, d, ago(RUNS_AS_OF, hours=t["deployment"]["window_hours"]))
    v, c = t["volume"], t["cost"]
    return {
        "latest_run_state": lambda: monitors.latest_run_state(month, RUNS_AS_OF, t["telemetry"]["window_hours"]),
        "freshness": lambda: monitors.freshness(month, RUNS_AS_OF, t["freshness"]["warn_seconds"], t["freshness"]["fail_seconds"]),
        "missing_scheduled_run": lambda: monitors.missing_scheduled_run(month, RUNS_AS_OF, t["missing_run"]["grace_seconds"]),
        "telemetry_completeness": lambda: monitors.telemetry_completeness(
            month, task_events(spark, d), RUNS_AS_OF, len(EXPECTED_TASKS), t["telemetry"]["window_hours"]
        ),
        "reconciliation": lambda: monitors.reconciliation(
            quality(spark, d), JOBS_AS_OF, t["reconciliation"]["window_hours"],
            quality(spark, d, ago(JOBS_AS_OF, hours=t["reconciliation"]["window_hours"])),
        ),
        "volume_deviation": lambda: monitors.volume_deviation(
            month, RUNS_AS_OF, v["baseline_window_runs"], v["warn_deviation"], v["fail_deviation"], v["min_baseline_rows"]
        ),
        "rejection_rate": lambda: monitors.rejection_rate(month, RUNS_AS_OF, t["rejection_rate"]["warn"], t["rejection_rate"]["fail"]),
        "deployment_failure": lambda: monitors.deployment_failure(deployed, RUNS_AS_OF, t["deployment"]["window_hours"]),
        "rollback_failure": lambda: monitors.deployment_failure(deployed, RUNS_AS_OF, t["deployment"]["window_hours"], rollback_only=True),
        "cost_anomaly": lambda: monitors.cost_anomaly(
            jobs(spark, d, ago(JOBS_AS_OF, days=c["baseline_window_days"] + 1)), JOBS_AS_OF, window_hours=c["window_hours"],
            baseline_days=c["baseline_window_days"], warn=c["warn_ratio"], fail=c["fail_ratio"], min_bytes=c["min_bytes_billed"],
        ),
    }


MON_SQL = {
    "mon_latest_run": ("latest_run_state", w(O_RUNS) + MON_LATEST),
    "mon_freshness": ("freshness", w(O_RUNS) + MON_FRESH),
    "mon_missing_run": ("missing_scheduled_run", w(O_RUNS) + MON_MISSING),
    "mon_telemetry": ("telemetry_completeness", w(O_RUNS, O_TASKS) + MON_TELEMETRY),
    "mon_reconciliation": ("reconciliation", w(O_QUALITY) + MON_RECON),
    "mon_volume": ("volume_deviation", w(O_RUNS, O_RECENT) + MON_VOLUME),
    "mon_rejection": ("rejection_rate", w(O_RUNS) + MON_REJECT),
    "mon_deployment": ("deployment_failure", w(O_DEPLOY) + mon_deploy_sql(False)),
    "mon_rollback": ("rollback_failure", w(O_DEPLOY) + mon_deploy_sql(True)),
    "mon_cost": ("cost_anomaly", w(O_JOBS) + MON_COST),
}

for _key, (_check, _sql) in MON_SQL.items():
    query(_key, _sql)(lambda spark, d, _c=_check: _checks(spark, d)[_c]())

MON_ALL_SQL = (
    w(O_RUNS, O_DEPLOY, O_TASKS, O_QUALITY, O_JOBS, O_RECENT)
    + "\nUNION ALL\n".join(
        f"SELECT * FROM ({s})" for s in [
            MON_LATEST, MON_FRESH, MON_MISSING, MON_TELEMETRY, MON_RECON, MON_VOLUME, MON_REJECT,
            mon_deploy_sql(False), mon_deploy_sql(True), MON_COST,
        ]
    )
)


UNREADABLE = "SELECT 'unreadable_ledger' AS check_name, 'NO_DATA' AS status, 'WARNING' AS severity, NULL::DOUBLE AS observed_value, NULL::DOUBLE AS threshold"


@query("monitor_all", MON_ALL_SQL)
def q_monitor_all(spark, d):
    return monitors.monitor_all(_checks(spark, d)).select(*monitors.RESULT_COLUMNS)


@query("monitor_isolation", MON_ALL_SQL + "\nUNION ALL\n" + UNREADABLE)
def q_monitor_isolation(spark, d):
    """All checks, and one whose rows cannot be read while it runs: it becomes NO_DATA, the others keep their verdicts."""
    unreadable = runs(spark, d, RUNS_AS_OF - dt.timedelta(days=2)).select(
        F.lit("unreadable_ledger").alias("check_name"), F.raise_error(F.lit("ledger row without a status")).cast("string").alias("status"),
        F.lit("INFO").alias("severity"), F.lit(0.0).alias("observed_value"), F.lit(0.0).alias("threshold"),
    ).limit(1)
    return monitors.monitor_all(_checks(spark, d) | {"unreadable_ledger": lambda: unreadable}).select(*monitors.RESULT_COLUMNS)


OVERRIDES = [("rejection_rate", "warn", 0.001), ("rejection_rate", "fail", 0.002), ("volume", "min_baseline_rows", 10.0**9), ("freshness", "fail_seconds", 1.0), ("freshness", "warn_seconds", 1.0)]


def _overridden() -> str:
    reject = MON_REJECT.replace("0.35", "0.002").replace("0.2 ", "0.001 ").replace("0.2)", "0.001)").replace("0.20", "0.001")
    fresh = MON_FRESH.replace("180000", "1").replace("93600", "1")
    volume = MON_VOLUME.replace("baseline < 1000", "baseline < 1000000000")
    return w(O_RUNS, O_RECENT) + "\nUNION ALL\n".join(f"SELECT * FROM ({s})" for s in (fresh, volume, reject))


@query("monitor_overrides", _overridden())
def q_monitor_overrides(spark, d):
    """Three checks under thresholds that a table overrides."""
    t = monitors.thresholds(spark.createDataFrame(OVERRIDES, "section string, name string, value double"))
    checks = _checks(spark, d, t)
    names = ("freshness", "volume_deviation", "rejection_rate")
    return monitors.monitor_all({n: checks[n] for n in names}).select(*monitors.RESULT_COLUMNS)


@query(
    "monitor_metrics",
    f"""WITH results AS (SELECT * FROM ({MON_ALL_SQL}))
        SELECT 'monitor/check_status' AS metric_type, MAP {{'environment': 'dev', 'mode': 'normal', 'check_name': check_name}} AS labels,
          CAST(CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 WHEN 'NO_DATA' THEN -1 ELSE -2 END AS DOUBLE) AS value
        FROM results
        UNION ALL
        SELECT CASE check_name WHEN 'latest_run_state' THEN 'pipeline/run_duration_seconds' WHEN 'freshness' THEN 'pipeline/last_success_age_seconds'
            WHEN 'telemetry_completeness' THEN 'pipeline/telemetry_incomplete_count' WHEN 'reconciliation' THEN 'data/reconciliation_failure_count'
            WHEN 'volume_deviation' THEN if(status = 'NO_DATA', 'data/raw_row_count', 'data/volume_deviation_ratio')
            WHEN 'rejection_rate' THEN 'data/rejection_rate' WHEN 'deployment_failure' THEN 'deployment/latest_failed' END,
          MAP {{'environment': 'dev', 'mode': 'normal'}}, observed_value
        FROM results WHERE observed_value IS NOT NULL AND check_name NOT IN ('missing_scheduled_run', 'rollback_failure', 'cost_anomaly')""",
)
def q_monitor_metrics(spark, d):
    return monitors.monitor_metrics(monitors.monitor_all(_checks(spark, d)))


# --------------------------------------------------------------------- costs
@query(
    "cost_daily",
    w(O_JOBS)
    + """SELECT CAST(creation_time AS DATE) AS usage_date, count(*) AS job_count,
           CAST(sum(total_bytes_processed) AS BIGINT) AS bytes_processed, CAST(sum(total_bytes_billed) AS BIGINT) AS bytes_billed,
           round(sum(total_bytes_billed) / pow(2, 40) * 6.25, 4) AS approx_usd_on_demand
         FROM jobs WHERE is_app AND statement_type != 'SCRIPT' GROUP BY 1""",
)
def q_cost_daily(spark, d):
    return costs.cost_daily(jobs(spark, d))


@query(
    "cost_window",
    w(O_JOBS)
    + f"""SELECT * FROM (
           SELECT 'day ' || CAST(creation_time AS DATE) AS what, count(*) AS jobs, CAST(sum(total_bytes_billed) AS BIGINT) AS bytes_billed FROM jobs
             WHERE is_app AND statement_type != 'SCRIPT' AND creation_time >= {JA} - INTERVAL 30 DAY GROUP BY 1
           UNION ALL SELECT 'component ' || list_filter(labels, lambda l: l.key = 'component')[1].value, count(*), CAST(sum(total_bytes_billed) AS BIGINT) FROM jobs
             WHERE is_app AND statement_type != 'SCRIPT' AND creation_time >= {JA} - INTERVAL 7 DAY GROUP BY 1)""",
)
def q_cost_window(spark, d):
    """Cost reports over trailing windows, a month by day and a week by component, each on a scan bounded by its window."""
    ago = lambda n: jobs(spark, d, JOBS_AS_OF - dt.timedelta(days=n))
    daily = costs.cost_daily(ago(30), JOBS_AS_OF, 30)
    component = costs.cost_by_component(ago(7), JOBS_AS_OF, 7)
    return daily.select(F.concat(F.lit("day "), F.col("usage_date").cast("string")).alias("what"), F.col("job_count").alias("jobs"), "bytes_billed").unionByName(
        component.select(F.concat(F.lit("component "), "component").alias("what"), F.col("job_count").alias("jobs"), "bytes_billed")
    )


@query(
    "cost_slots_daily",
    w(O_JOBS)
    + """SELECT CAST(creation_time AS DATE) AS usage_date, CAST(sum(total_slot_ms) AS BIGINT) AS slot_ms
         FROM jobs WHERE is_app AND statement_type != 'SCRIPT' GROUP BY 1""",
)
def q_cost_slots(spark, d):
    return costs.cost_slots_daily(jobs(spark, d))


@query(
    "cost_failures",
    w(O_JOBS)
    + """SELECT CAST(creation_time AS DATE) AS usage_date, error_result.reason AS error_reason, count(*) AS failed_jobs
         FROM jobs WHERE is_app AND error_result IS NOT NULL GROUP BY 1, 2""",
)
def q_cost_failures(spark, d):
    return costs.cost_failures(jobs(spark, d))


@query(
    "cost_by_component",
    w(O_JOBS)
    + """SELECT list_filter(labels, lambda l: l.key = 'component')[1].value AS component, count(*) AS job_count,
           CAST(sum(total_bytes_billed) AS BIGINT) AS bytes_billed, CAST(sum(total_slot_ms) AS BIGINT) AS slot_ms
         FROM jobs WHERE is_app AND statement_type != 'SCRIPT' GROUP BY 1""",
)
def q_cost_by_component(spark, d):
    return costs.cost_by_component(jobs(spark, d))


@query(
    "job_component",
    w(O_JOBS)
    + """SELECT job_id, list_filter(labels, lambda l: l.key = 'component')[1].value AS component, is_app
         FROM jobs""",
)
def q_job_component(spark, d):
    j = jobs(spark, d)
    return j.select(
        "job_id",
        costs.label_value("labels", "component").alias("component"),
        monitors.has_label("labels", *ad.APP_LABEL).alias("is_app"),
    )


@query(
    "cost_top_jobs",
    w(O_JOBS)
    + """SELECT creation_time, job_id, user_email, list_filter(labels, lambda l: l.key = 'component')[1].value AS component,
           total_bytes_billed, total_slot_ms
         FROM jobs WHERE is_app AND statement_type != 'SCRIPT' AND total_bytes_billed > 1073741824
         ORDER BY total_bytes_billed DESC, job_id ASC LIMIT 50""",
)
def q_cost_top_jobs(spark, d):
    return costs.cost_top_jobs(jobs(spark, d))


@query(
    "cost_weekly",
    w(O_JOBS)
    + """SELECT date_trunc('week', creation_time + INTERVAL 1 DAY) - INTERVAL 1 DAY AS week_start,
           count_if(is_app) AS labeled_jobs, count_if(NOT is_app) AS unlabeled_jobs,
           CAST(sum(total_bytes_billed) AS BIGINT) AS bytes_billed
         FROM jobs WHERE statement_type != 'SCRIPT'
           AND (is_app OR user_email IN ('pipeline-runtime@example.iam', 'ci-integration@example.iam', 'ci-deployer@example.iam'))
         GROUP BY 1""",
)
def q_cost_weekly(spark, d):
    return costs.cost_weekly(jobs(spark, d))

"""Registered queries: ops lookups, telemetry gaps, performance-suite queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.operators import ops
from lakeward.plans.oracle import with_core
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.q_ops import (
    EXPECTED_TASKS, JA, O_DEPLOY, O_RUNS, O_TASKS, RA, RUNS_AS_OF, deployments, runs, task_events, w,
)
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table

EXCLUDED_SHA = "c4ca4238a0b9"  # md5('1')[:12]: the sha being rolled back from


@query(
    "latest_run",
    w(O_RUNS) + """SELECT environment, arg_max(pipeline_run_id, (started_at, pipeline_run_id)) AS pipeline_run_id,
        arg_max(status, (started_at, pipeline_run_id)) AS status, max(started_at) AS started_at
      FROM runs GROUP BY 1""",
)
def q_latest_run(spark, d):
    return ops.latest_run(runs(spark, d))


@query(
    "rollback_target",
    w(O_DEPLOY) + f"""SELECT environment, arg_max(deployment_id, (completed_at, deployment_id)) AS deployment_id,
        arg_max(git_sha, (completed_at, deployment_id)) AS git_sha, max(completed_at) AS completed_at
      FROM deployments WHERE status = 'SUCCESS' AND git_sha != '{EXCLUDED_SHA}' GROUP BY 1""",
)
def q_rollback_target(spark, d):
    return ops.rollback_target(deployments(spark, d), EXCLUDED_SHA)


@query(
    "run_durations",
    w(O_RUNS) + f"""SELECT pipeline_run_id, status, date_sub('second', started_at, coalesce(completed_at, {RA})) AS duration_s
      FROM runs""",
)
def q_run_durations(spark, d):
    return ops.run_durations(runs(spark, d), RUNS_AS_OF)


@query("run_outcomes", w(O_RUNS) + "SELECT status, count(*) AS runs FROM runs GROUP BY 1")
def q_run_outcomes(spark, d):
    return ops.run_outcomes(runs(spark, d))


@query(
    "task_event_trace",
    w(O_RUNS, O_TASKS)
    + """SELECT *, row_number() OVER (PARTITION BY pipeline_run_id ORDER BY task_id, attempt, event_type, event_time)::INT AS step
         FROM task_events WHERE pipeline_run_id IN (SELECT pipeline_run_id FROM runs WHERE status = 'FAILED')""",
)
def q_task_event_trace(spark, d):
    """The task events of failed runs, numbered in diagnostic order."""
    return ops.task_event_trace(task_events(spark, d), runs(spark, d).where("status = 'FAILED'"))


@query(
    "run_lookup",
    w(O_RUNS, O_TASKS) + """SELECT * FROM runs WHERE pipeline_run_id IN
        (SELECT pipeline_run_id FROM task_events WHERE event_type = 'FAILED' AND task_id = 'task_1')""",
)
def q_run_lookup(spark, d):
    """Point lookups of the runs named by failed first tasks (key set from data)."""
    keys = task_events(spark, d).filter((F.col("event_type") == "FAILED") & (F.col("task_id") == "task_1"))
    return ops.lookup_first(runs(spark, d), keys, "pipeline_run_id", ["started_at"]).select(
        *runs(spark, d).columns
    )


GAPS_SQL = w(O_RUNS, O_TASKS) + """,
term AS (SELECT DISTINCT pipeline_run_id, task_id FROM task_events
         WHERE event_type IN ('SUCCESS','FAILED','SKIPPED','UPSTREAM_FAILED')),
exp AS (SELECT pipeline_run_id, unnest(['task_1','task_2','task_3']) AS task_id FROM runs WHERE status IN ('SUCCESS','FAILED')),
gaps AS (
  SELECT pipeline_run_id, task_id, 'missing_terminal' AS gap_type FROM exp
  WHERE NOT EXISTS (SELECT 1 FROM term t WHERE t.pipeline_run_id = exp.pipeline_run_id AND t.task_id = exp.task_id)
  UNION ALL
  SELECT DISTINCT pipeline_run_id, task_id, 'started_not_terminal' FROM task_events s WHERE event_type = 'STARTED'
    AND NOT EXISTS (SELECT 1 FROM term t WHERE t.pipeline_run_id = s.pipeline_run_id AND t.task_id = s.task_id))
"""


@query("telemetry_completeness", GAPS_SQL + "SELECT * FROM gaps")
def q_telemetry_completeness(spark, d):
    return ops.telemetry_gaps(runs(spark, d), task_events(spark, d), EXPECTED_TASKS)


@query(
    "upstream_failed_rows",
    GAPS_SQL.replace("WHERE status IN ('SUCCESS','FAILED')", "WHERE status = 'FAILED'")
    + """SELECT pipeline_run_id, task_id, CAST(1 AS BIGINT) AS attempt, 'UPSTREAM_FAILED' AS event_type
         FROM gaps WHERE gap_type = 'missing_terminal'""",
)
def q_upstream_failed_rows(spark, d):
    return ops.upstream_failed_rows(runs(spark, d), task_events(spark, d), EXPECTED_TASKS)


@query(
    "task_timing",
    w(O_TASKS) + f"""SELECT pipeline_run_id, task_id,
        CASE WHEN s IS NULL THEN NULL ELSE s END AS started_at,
        CASE WHEN s IS NULL THEN NULL ELSE coalesce(e, {JA}) END AS ended_at,
        CASE WHEN s IS NULL THEN NULL ELSE greatest(0, date_sub('millisecond', s, coalesce(e, {JA}))) END AS duration_ms,
        CASE WHEN s IS NULL THEN 'none' WHEN e IS NULL THEN 'partial' ELSE 'exact' END AS timing_confidence
      FROM (SELECT pipeline_run_id, task_id,
              min(CASE WHEN event_type = 'STARTED' THEN event_time END) AS s,
              max(CASE WHEN event_type IN ('SUCCESS','FAILED','SKIPPED','UPSTREAM_FAILED') THEN event_time END) AS e
            FROM task_events GROUP BY 1, 2)""",
)
def q_task_timing(spark, d):
    import datetime as dt

    return ops.task_timing(task_events(spark, d), dt.datetime(2001, 11, 5))


@query(
    "backfill_calendar",
    """SELECT d::DATE AS missing_date FROM range(DATE '2024-01-01', DATE '2024-02-11', INTERVAL 1 DAY) t(d)
       WHERE d::DATE NOT IN (SELECT DISTINCT CAST(ts AS DATE) FROM events)""",
)
def q_backfill_calendar(spark, d):
    ev = read_table(spark, d, "events").select(F.to_date("ts").alias("event_date"))
    return ops.backfill_calendar(ev, "2024-01-01", "2024-02-10", override=True)


# ---------------------------------------------------------- batch metrics D18
@query(
    "batch_metrics",
    with_core(
        """SELECT batch_id, * EXCLUDE (batch_id) FROM (
             SELECT batch_id, 'rows_loaded' AS metric, count(*) AS v FROM raw WHERE batch_id IS NOT NULL GROUP BY 1
             UNION ALL SELECT batch_id, 'rows_accepted', count(*) FROM accepted WHERE batch_id IS NOT NULL GROUP BY 1
             UNION ALL SELECT batch_id, 'rows_rejected', count(*) FROM rejected WHERE batch_id IS NOT NULL GROUP BY 1
             UNION ALL SELECT batch_id, 'fact_rows', count(*) FROM fact WHERE batch_id IS NOT NULL GROUP BY 1
           ) PIVOT (first(v) FOR metric IN ('fact_rows', 'rows_accepted', 'rows_loaded', 'rows_rejected'))"""
    ),
)
def q_batch_metrics(spark, d):
    """Loaded / accepted / rejected / fact rows per batch; a relation with no
    rows for a batch leaves that metric NULL (absent)."""
    p = Pipeline(spark, d, materialize=True)
    parts = [
        (p.raw, "rows_loaded"), (p.accepted, "rows_accepted"), (p.rejected, "rows_rejected"), (p.fact, "fact_rows"),
    ]
    counts = reduce(
        DataFrame.unionByName,
        [
            df.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.count(F.lit(1)).alias("v")).withColumn("metric", F.lit(m))
            for df, m in parts
        ],
    )
    return counts.groupBy("batch_id").pivot("metric", sorted(m for _, m in parts)).agg(F.first("v"))


# -------------------------------------------------------- performance suite
@query(
    "perf_raw_lookup",
    with_core("SELECT event_date, count(*) AS row_count, count(DISTINCT event_id) AS distinct_ids FROM raw GROUP BY 1"),
)
def q_perf_raw_lookup(spark, d):
    return Pipeline(spark, d).raw.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("event_id").alias("distinct_ids")
    )


@query(
    "perf_batch_profile",
    with_core("SELECT batch_id, count_if(user_id IS NULL) AS null_users, count(*) AS total FROM stg GROUP BY 1"),
)
def q_perf_batch_profile(spark, d):
    return Pipeline(spark, d).stg.groupBy("batch_id").agg(
        F.count_if(F.col("user_id").isNull()).alias("null_users"), F.count(F.lit(1)).alias("total")
    )


@query(
    "perf_reconciliation",
    with_core(
        """SELECT coalesce(r.event_date, f.event_date) AS event_date, coalesce(raw_rows, 0) AS raw_rows,
             coalesce(fact_rows, 0) AS fact_rows
           FROM (SELECT event_date, count(*) AS raw_rows FROM raw GROUP BY 1) r
           FULL JOIN (SELECT event_date, count(*) AS fact_rows FROM fact GROUP BY 1) f USING (event_date)"""
    ),
)
def q_perf_reconciliation(spark, d):
    p = Pipeline(spark, d)
    r = p.raw.groupBy("event_date").agg(F.count(F.lit(1)).alias("raw_rows"))
    f = p.fact.groupBy("event_date").agg(F.count(F.lit(1)).alias("fact_rows"))
    return r.join(f, "event_date", "full_outer").na.fill(0, ["raw_rows", "fact_rows"])


@query(
    "perf_mart_rollup",
    with_core(
        """SELECT event_date, CAST(sum(event_count) AS BIGINT) AS events FROM
             (SELECT event_date, count(*) AS event_count FROM fact GROUP BY event_date, event_name, country_code, platform)
           GROUP BY 1 ORDER BY 1"""
    ),
)
def q_perf_mart_rollup(spark, d):
    return Pipeline(spark, d).mart.groupBy("event_date").agg(F.sum("event_count").cast("bigint").alias("events")).orderBy(
        "event_date"
    )


@query(
    "perf_freshness",
    with_core(
        """SELECT max(ingested_at) AS max_ingested_at,
             date_sub('second', max(ingested_at), TIMESTAMP '2024-02-01 00:00:00') AS staleness_seconds FROM raw"""
    ),
)
def q_perf_freshness(spark, d):
    import datetime as dt

    return Pipeline(spark, d).raw.agg(F.max("ingested_at").alias("max_ingested_at")).select(
        "max_ingested_at",
        F.timestamp_diff("SECOND", F.col("max_ingested_at"), F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")).alias(
            "staleness_seconds"
        ),
    )

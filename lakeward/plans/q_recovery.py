"""Registered queries: smoke test and recovery verification per batch, recovery actions by optional filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.operators import ops, recovery, suites
from lakeward.operators.publish import dim_countries
from lakeward.plans.oracle import with_core
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.q_suites import WAREHOUSE_CTES, WAREHOUSE_SELECT, expected_batches
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table

TASKS = ["load_raw", "build_warehouse", "validate_warehouse"]


def days(spark, d):
    """One row per day of events: the day's number in its month, its batch, run and deployment."""
    day = F.date_format("ts", "yyyyMMdd")
    return read_table(spark, d, "events").groupBy(day.alias("d")).agg(F.count_if(F.col("event_id") % 97 != 8).alias("n"), F.count_if((F.col("event_id") % 97 != 8) & (F.col("event_id") % 200 == 1)).alias("again")).select(
        F.concat(F.lit("b-"), "d").alias("batch_id"), F.concat(F.lit("run-"), "d").alias("pipeline_run_id"), F.concat(F.lit("dep-"), "d").alias("deployment_id"),
        F.substring("d", 7, 2).cast("int").alias("day"), (F.col("n") + F.col("again")).alias("landed"),
    )


def expected(x):
    """What the manifest says: day 5 is one row short of it."""
    return x.select("batch_id", "pipeline_run_id", "deployment_id", (F.col("landed") + F.when(F.col("day") == 5, 1).otherwise(0)).alias("expected_rows"))


def audit_runs(x):
    """Audit rows of the runs: days ending in 6 have none, days ending in 4 failed, day 8 is still running."""
    status = F.when(F.col("day") % 10 == 4, "FAILED").when(F.col("day") == 8, "RUNNING").otherwise("SUCCESS")
    return x.where("day % 10 <> 6").select("pipeline_run_id", status.alias("status"), F.col("day"))


def suite_of(spark, d):
    p = Pipeline(spark, d, materialize=True)
    suite = suites.warehouse_validation(
        p.raw, p.classified, p.accepted, p.rejected, p.fact, p.dim_users, dim_countries(spark), p.mart, expected_batches(spark, d)
    )
    return p.raw, suite


O_DAYS = """daily AS (
  SELECT 'b-' || strftime(ts, '%Y%m%d') AS batch_id, 'run-' || strftime(ts, '%Y%m%d') AS pipeline_run_id, day(ts) AS day,
         count_if(event_id % 97 <> 8) + count_if(event_id % 97 <> 8 AND event_id % 200 = 1) AS landed
  FROM events GROUP BY ALL)"""
O_FIGURES = """figures AS (
  SELECT batch_id, sum(n)::BIGINT AS raw_rows, count(DISTINCT pipeline_run_id) AS loads, sum(n - 1)::BIGINT AS repeated
  FROM (SELECT batch_id, event_id, pipeline_run_id, count(*) AS n FROM raw WHERE batch_id IS NOT NULL GROUP BY ALL) GROUP BY 1)"""
O_SUITE = f"""suite AS ({WAREHOUSE_SELECT}),
suite_failed AS (
  SELECT batch_id, count_if(status = 'FAIL') + (SELECT count_if(status = 'FAIL') FROM suite WHERE batch_id IS NULL) AS suite_failed
  FROM suite WHERE batch_id IS NOT NULL AND check_name <> 'overall' GROUP BY 1)"""


def stacked(source: str, checks: list[tuple[str, str, str, str]]) -> str:
    each = "\nUNION ALL ".join(
        f"SELECT batch_id, '{n}' AS check_name, if({p}, 'PASS', 'FAIL') AS status, ({e})::BIGINT AS expected, ({a})::BIGINT AS actual FROM {source}" for n, p, e, a in checks
    )
    return f"SELECT * FROM ({each}) UNION ALL SELECT batch_id, 'overall', if(bool_and(status = 'PASS'), 'PASS', 'FAIL'), NULL, NULL FROM ({each}) GROUP BY 1"


@query(
    "batch_smoke",
    with_core(
        stacked("x", [
            ("raw_batch_count", "raw_rows = expected_rows", "expected_rows", "raw_rows"),
            ("no_duplicate_load", "loads = 1", "1", "loads"),
            ("warehouse_reconciliation", "suite_failed = 0", "0", "suite_failed"),
            ("pipeline_runs_success", "successes = 1", "1", "successes"),
            ("deployments_row", "deployed = 1", "1", "deployed"),
        ]),
        *WAREHOUSE_CTES, O_DAYS, O_FIGURES, O_SUITE,
        """x AS (SELECT y.batch_id, landed + if(day = 5, 1, 0) AS expected_rows, raw_rows, loads, suite_failed,
                   if(day % 10 IN (4, 6) OR day = 8, 0, 1) AS successes, CASE WHEN day % 7 = 3 THEN 2 WHEN day % 7 = 5 THEN 0 ELSE 1 END AS deployed
             FROM daily y JOIN figures USING (batch_id) JOIN suite_failed USING (batch_id))""",
    ),
)
def q_batch_smoke(spark, d):
    """Every day's batch after a deployment: a short count, missing and failed runs, doubled and missing deployment rows."""
    x = days(spark, d)
    raw, suite = suite_of(spark, d)
    copies = F.when(F.col("day") % 7 == 3, 2).when(F.col("day") % 7 == 5, 0).otherwise(1)
    deployments = x.select("deployment_id", F.explode(F.array_repeat(F.lit(1), copies)).alias("one")).select("deployment_id")
    return recovery.batch_smoke(expected(x), raw, suite, audit_runs(x), deployments)


@query(
    "recovery_verification",
    with_core(
        stacked("x", [
            ("raw_count_exact", "raw_rows = expected_rows", "expected_rows", "raw_rows"),
            ("warehouse_checks", "suite_failed = 0", "0", "suite_failed"),
            ("zero_duplicate_rows", "repeated = 0", "0", "repeated"),
            ("run_terminal", "terminal = 1", "1", "terminal"),
            ("telemetry_complete", "gaps = 0", "0", "gaps"),
            ("action_verified", "verified = 1", "1", "verified"),
            ("monitors_pass", "true", "0", "0"),
        ]),
        *WAREHOUSE_CTES, O_DAYS, O_FIGURES, O_SUITE,
        """x AS (SELECT y.batch_id, landed + if(day = 5, 1, 0) AS expected_rows, raw_rows, repeated, suite_failed,
                   if(day % 10 = 6 OR day = 8, 0, 1) AS terminal,
                   CASE WHEN day % 10 = 6 OR day = 8 THEN 0 WHEN day = 12 THEN 1 WHEN day = 13 THEN 2 ELSE 0 END AS gaps,
                   if(day % 11 IN (1, 2), 0, 1) AS verified
             FROM daily y JOIN figures USING (batch_id) JOIN suite_failed USING (batch_id))""",
    ),
)
def q_recovery_verification(spark, d):
    """Every day's batch after a recovery: short counts, repeated rows, runs without an end, missing task events,
    actions that are not verified."""
    x = days(spark, d)
    raw, suite = suite_of(spark, d)
    runs = audit_runs(x)
    # day 12: a task that only ever retried; day 13: two tasks without any event
    tasks = x.select("pipeline_run_id", "day", F.explode(F.array(*[F.lit(t) for t in TASKS])).alias("task_id"))
    tasks = tasks.where("not (day = 13 and task_id in ('load_raw', 'build_warehouse'))").select(
        "pipeline_run_id", "task_id", F.lit(1).alias("attempt"),
        F.when((F.col("day") == 12) & (F.col("task_id") == "load_raw"), "RETRY").otherwise("SUCCESS").alias("event_type"),
    )
    gaps = ops.telemetry_gaps(runs, tasks, TASKS)
    actions = x.select(
        "batch_id",
        F.when(F.col("day") % 11 == 1, "RUNNING").otherwise("SUCCESS").alias("status"),
        F.when(F.col("day") % 11 == 2, "PENDING").otherwise("VERIFIED").alias("verification_status"),
    )
    monitors = x.groupBy().agg(F.lit("PASS").alias("status"))
    return recovery.recovery_verification(expected(x), raw, suite, runs, gaps, actions, monitors)


def actions(spark, d):
    """orders -> recovery actions with a scenario, an incident and a batch."""
    k = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(
        k.alias("recovery_id"), F.concat(F.lit("S-"), (k % 7).cast("string")).alias("scenario_id"),
        F.when(k % 3 == 0, F.concat(F.lit("inc-"), (k % 4).cast("string"))).alias("incident_id"),
        F.concat(F.lit("b-"), F.date_format("o_orderdate", "yyyyMM")).alias("batch_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"),
    )


@query(
    "recovery_actions_for",
    """WITH a AS (SELECT o_orderkey AS recovery_id, 'S-' || o_orderkey % 7 AS scenario_id,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'inc-' || o_orderkey % 4 END AS incident_id, 'b-' || strftime(o_orderdate, '%Y%m') AS batch_id FROM orders)
       SELECT 'scenario' AS asked, recovery_id FROM a WHERE scenario_id = 'S-3'
       UNION ALL SELECT 'incident and batch', recovery_id FROM a WHERE incident_id = 'inc-2' AND batch_id = 'b-199803'
       UNION ALL SELECT 'all', recovery_id FROM a""",
)
def q_recovery_actions_for(spark, d):
    """The same lookup with one filter, with two, and with none."""
    asked = {"scenario": {"scenario_id": "S-3"}, "incident and batch": {"incident_id": "inc-2", "batch_id": "b-199803"}, "all": {}}
    parts = [recovery.recovery_actions_for(actions(spark, d), **k).select(F.lit(n).alias("asked"), "recovery_id") for n, k in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

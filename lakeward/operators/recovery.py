"""Verification of a batch after a deployment or a recovery, and lookups of recovery actions.

Both verdicts are compositions: suites, audit rows and monitor results come in as
tables, one row per batch and check goes out, and a batch passes if all its checks do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.operators.suites import check, stack_checks

TERMINAL_RUNS = ["SUCCESS", "FAILED"]
FINAL_ACTIONS = ["SUCCESS", "PARTIAL", "FAILED"]


def recovery_actions_for(actions: DataFrame, *, scenario_id: str | None = None, incident_id: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Recovery actions, filtered by what is given; an argument left out filters nothing. In the order they started."""
    given = {"scenario_id": scenario_id, "incident_id": incident_id, "batch_id": batch_id}
    for name, value in given.items():
        if value is not None:
            actions = actions.where(F.col(name) == value)
    return actions.orderBy("started_at", "recovery_id")


def _per_batch(batches: DataFrame, *facts: DataFrame) -> DataFrame:
    """One row per batch that is asked for; every fact table has at most one row per batch."""
    return reduce(lambda a, b: a.join(b, "batch_id", "left"), facts, batches)


def _with_overall(df: DataFrame, checks: list[tuple]) -> DataFrame:
    ok = reduce(lambda a, b: a & b, [F.coalesce(c[1], F.lit(False)) for c in checks])
    checks = [(n, F.coalesce(p, F.lit(False)), e, a) for n, p, e, a in checks]
    return stack_checks(df, ["batch_id"], [check(*c) for c in checks] + [check("overall", ok, None, None)])


def suite_verdicts(suite: DataFrame) -> DataFrame:
    """``batch_id, suite_failed``: failed checks of a batch in a suite, global ones included (its ``overall`` is not counted)."""
    shared = suite.where("batch_id is null").agg(F.count_if(F.col("status") == "FAIL").alias("shared")).withColumn("k", F.lit(1))
    own = suite.where("batch_id is not null and check_name <> 'overall'").groupBy("batch_id").agg(F.count_if(F.col("status") == "FAIL").alias("own"))
    return own.withColumn("k", F.lit(1)).join(shared, "k").select("batch_id", (F.col("own") + F.col("shared")).alias("suite_failed"))


def raw_figures(raw: DataFrame) -> DataFrame:
    """``batch_id, raw_rows, loads, repeated``: rows, ingestion runs, and rows beyond the first of an event id in a run."""
    per_id = raw.where("batch_id is not null").groupBy("batch_id", "event_id", "pipeline_run_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("batch_id").agg(
        F.sum("n").alias("raw_rows"), F.count_distinct("pipeline_run_id").alias("loads"), F.sum(F.col("n") - 1).alias("repeated")
    )


def batch_smoke(expected: DataFrame, raw: DataFrame, suite: DataFrame, runs: DataFrame, deployments: DataFrame) -> DataFrame:
    """Data part of a deployment's smoke test per batch of ``expected`` (batch_id, expected_rows, pipeline_run_id,
    deployment_id): the exact raw count, one ingestion run, a passing warehouse suite, a successful run and one deployment row."""
    audit = runs.groupBy("pipeline_run_id").agg(F.count_if(F.col("status") == "SUCCESS").alias("successes"))
    deployed = deployments.groupBy("deployment_id").agg(F.count(F.lit(1)).alias("deployment_rows"))
    rows = _per_batch(expected, raw_figures(raw), suite_verdicts(suite)).join(audit, "pipeline_run_id", "left").join(deployed, "deployment_id", "left")
    rows = rows.na.fill(0, ["raw_rows", "loads", "successes", "deployment_rows"])
    return _with_overall(rows, [
        ("raw_batch_count", F.col("raw_rows") == F.col("expected_rows"), F.col("expected_rows"), F.col("raw_rows")),
        ("no_duplicate_load", F.col("loads") == 1, 1, F.col("loads")),
        ("warehouse_reconciliation", F.col("suite_failed") == 0, 0, F.col("suite_failed")),
        ("pipeline_runs_success", F.col("successes") > 0, 1, F.col("successes")),
        ("deployments_row", F.col("deployment_rows") == 1, 1, F.col("deployment_rows")),
    ])


def recovery_verification(
    expected: DataFrame, raw: DataFrame, suite: DataFrame, runs: DataFrame, gaps: DataFrame, actions: DataFrame, monitors: DataFrame
) -> DataFrame:
    """What has to hold before a recovery of a batch counts as a success, per batch of ``expected`` (batch_id,
    expected_rows, pipeline_run_id): raw count, the warehouse suite, no repeated rows, a terminal run, complete
    telemetry (no row in ``gaps``), a finalized and verified action, and monitors back at PASS."""
    audit = runs.groupBy("pipeline_run_id").agg(F.count_if(F.col("status").isin(TERMINAL_RUNS)).alias("terminal"))
    missing = gaps.groupBy("pipeline_run_id").agg(F.count(F.lit(1)).alias("gaps"))
    done = actions.where(F.col("status").isin(FINAL_ACTIONS))
    done = done.groupBy("batch_id").agg(F.count_if(F.col("verification_status") == "VERIFIED").alias("verified"))
    alarms = monitors.agg(F.count_if(~F.col("status").isin("PASS", "DISABLED")).alias("alarms")).withColumn("k", F.lit(1))
    rows = _per_batch(expected, raw_figures(raw), suite_verdicts(suite), done)
    rows = rows.join(audit, "pipeline_run_id", "left").join(missing, "pipeline_run_id", "left").withColumn("k", F.lit(1)).join(alarms, "k")
    rows = rows.na.fill(0, ["raw_rows", "repeated", "terminal", "gaps", "verified"])
    return _with_overall(rows, [
        ("raw_count_exact", F.col("raw_rows") == F.col("expected_rows"), F.col("expected_rows"), F.col("raw_rows")),
        ("warehouse_checks", F.col("suite_failed") == 0, 0, F.col("suite_failed")),
        ("zero_duplicate_rows", F.col("repeated") == 0, 0, F.col("repeated")),
        ("run_terminal", F.col("terminal") > 0, 1, F.col("terminal")),
        ("telemetry_complete", F.col("gaps") == 0, 0, F.col("gaps")),
        ("action_verified", F.col("verified") > 0, 1, F.col("verified")),
        ("monitors_pass", F.col("alarms") == 0, 0, F.col("alarms")),
    ])


def recovery_outcome(verification: DataFrame) -> DataFrame:
    """``batch_id, outcome``: SUCCESS if all checks pass, FAILED if none does, else PARTIAL."""
    passed: Column = F.count_if(F.col("status") == "PASS")
    return verification.where("check_name <> 'overall'").groupBy("batch_id").agg(
        F.when(passed == F.count(F.lit(1)), "SUCCESS").when(passed == 0, "FAILED").otherwise("PARTIAL").alias("outcome")
    )

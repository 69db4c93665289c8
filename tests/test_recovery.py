"""Smoke and recovery verdicts, optional filters, the raw suite's reference dates and modes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeward.operators import recovery, suites
from lakeward.plans import q_tables
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def d(day):
    return dt.date(2024, 1, day)


@pytest.fixture
def parts(spark):
    f = spark.createDataFrame
    return {
        "expected": f([("a", 2, "ra"), ("b", 2, "rb"), ("gone", 5, "rg")], "batch_id string, expected_rows long, pipeline_run_id string"),
        "raw": f([("a", "1", "ra"), ("a", "2", "ra"), ("b", "1", "rb"), ("b", "1", "rb"), ("b", "2", "rc"), (None, "9", "rn")], "batch_id string, event_id string, pipeline_run_id string"),
        "suite": f([("a", "x", "PASS"), ("a", "overall", "FAIL"), ("b", "x", "FAIL"), (None, "global", "PASS")], "batch_id string, check_name string, status string"),
        "runs": f([("ra", "SUCCESS"), ("rb", "RUNNING")], "pipeline_run_id string, status string"),
    }


def statuses(rows):
    return {(r.batch_id, r.check_name): r.status for r in rows.collect()}


def test_recovery_needs_every_check(spark, parts):
    f = spark.createDataFrame
    gaps = f([("rb", "load", "missing_terminal")], "pipeline_run_id string, task_id string, gap_type string")
    actions = f([("a", "SUCCESS", "VERIFIED"), ("b", "RUNNING", "VERIFIED")], "batch_id string, status string, verification_status string")
    calm = f([("freshness", "PASS"), ("cost", "DISABLED")], "check_name string, status string")
    checked = recovery.recovery_verification(parts["expected"], parts["raw"], parts["suite"], parts["runs"], gaps, actions, calm)
    got = statuses(checked)
    assert {c for (b, c), s in got.items() if b == "a" and s != "PASS"} == set()
    assert {c for (b, c), s in got.items() if b == "b" and s == "PASS"} == {"monitors_pass"}
    assert got["gone", "overall"] == "FAIL" and got["gone", "warehouse_checks"] == "FAIL" and got["gone", "telemetry_complete"] == "PASS"
    assert {r.batch_id: r.outcome for r in recovery.recovery_outcome(checked).collect()} == {"a": "SUCCESS", "b": "PARTIAL", "gone": "PARTIAL"}
    alarm = f([("freshness", "WARN")], "check_name string, status string")
    assert statuses(recovery.recovery_verification(parts["expected"], parts["raw"], parts["suite"], parts["runs"], gaps, actions, alarm))["a", "overall"] == "FAIL"


def test_smoke(spark, parts):
    deployments = spark.createDataFrame([("da",), ("db",), ("db",)], "deployment_id string")
    expected = parts["expected"].withColumn("deployment_id", F.concat(F.lit("d"), "batch_id"))
    got = statuses(recovery.batch_smoke(expected, parts["raw"], parts["suite"], parts["runs"], deployments))
    assert got["a", "overall"] == "PASS"
    assert {c for (b, c), s in got.items() if b == "b" and s == "FAIL"} == {
        "raw_batch_count", "no_duplicate_load", "warehouse_reconciliation", "pipeline_runs_success", "deployments_row", "overall",
    }
    assert got["gone", "raw_batch_count"] == "FAIL"
    broken = parts["suite"].unionByName(spark.createDataFrame([(None, "global2", "FAIL")], parts["suite"].schema))
    assert statuses(recovery.batch_smoke(expected, parts["raw"], broken, parts["runs"], deployments))["a", "warehouse_reconciliation"] == "FAIL"


def test_filters_are_optional_and_rows_in_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(2, "s1", "i1", "b1", t), (1, "s1", None, "b2", t), (3, "s2", "i1", "b1", t - dt.timedelta(days=1))]
    actions = spark.createDataFrame(rows, "recovery_id int, scenario_id string, incident_id string, batch_id string, started_at timestamp_ntz")
    ids = lambda **k: [r.recovery_id for r in recovery.recovery_actions_for(actions, **k).collect()]
    assert ids() == [3, 1, 2] and ids(scenario_id="s1") == [1, 2] and ids(incident_id="i1", batch_id="b1") == [3, 2] and ids(batch_id="none") == []


def test_a_wrong_date_does_not_hide_itself(spark):
    raw = raw_events_from_driver(read_table(spark, SF, "events")).where("batch_id = 'b-20240105'")
    moved = raw.withColumn("processing_date", F.date_add("event_date", 0))  # every row claims its own date
    dates = spark.createDataFrame([("b-20240105", d(4))], "batch_id string, expected_date date")  # a day before its rows
    future = raw.where(F.col("event_date") > F.lit(d(4))).count()
    got = {r.check_name: r.actual for r in suites.raw_validation(moved, dates=dates).collect()}
    assert got["future_timestamps"] == future > 0 and got["partition_presence"] == raw.where(F.col("event_date") == F.lit(d(4))).count()
    unnamed = {r.check_name: (r.status, r.actual) for r in suites.raw_validation(moved, dates=dates.limit(0)).collect()}
    assert unnamed["partition_presence"] == ("FAIL", 0)


def test_modes_judge_by_different_checks(spark):
    raw = raw_events_from_driver(read_table(spark, SF, "events")).where("pipeline_run_id = 'run-20240105' and batch_id is not null")
    n, ids = raw.count(), raw.select("event_id").distinct().count()
    exact = {"expected_rows": n, "duplicate_event_ids": 2 * (n - ids)}
    batch = {r.check_name: r.status for r in suites.raw_validation(raw, **exact).collect()}
    run = {r.check_name: r.status for r in suites.raw_validation(raw, scope="run", as_of="2024-01-06", **exact).collect()}
    assert batch["invalid_country_codes"] == run["invalid_country_codes"] == "FAIL"
    assert batch["overall"] == "PASS" and run["overall"] == "FAIL"  # anomalies count in run mode only
    assert len(batch) == 13 and len(run) == 12 and "batch_id_populated" not in run


def test_partition_filters_reach_the_versioned_table(spark):
    plan = q_tables.q_perf_fact_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan

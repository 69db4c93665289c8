"""Monitor checks isolated while they run, thresholds from a table, persisted evaluations, bounded scans."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeward.operators import monitors
from lakeward.plans import q_ops

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 7, 20, 12)


@pytest.fixture
def runs(spark):
    rows = [(f"r{i}", NOW - dt.timedelta(days=i, hours=1), NOW - dt.timedelta(days=i), "SUCCESS", 1000 * (i + 1), 100) for i in range(5)]
    return spark.createDataFrame(rows, "pipeline_run_id string, started_at timestamp_ntz, completed_at timestamp_ntz, status string, rows_loaded long, rows_rejected long")


def checks(runs):
    broken = runs.select(
        F.lit("broken").alias("check_name"), F.raise_error(F.lit("cannot be read")).cast("string").alias("status"),
        F.lit("INFO").alias("severity"), F.lit(0.0).alias("observed_value"), F.lit(0.0).alias("threshold"),
    )
    return {
        "freshness": lambda: monitors.freshness(runs, NOW),
        "broken": lambda: broken,
        "unbuilt": lambda: runs.select("no_such_column"),
        "rejection_rate": lambda: monitors.rejection_rate(runs, NOW),
    }


def test_a_check_that_fails_while_running_takes_no_other_with_it(spark, runs):
    path = tempfile.mkdtemp(prefix="lw-mon-") + "/evaluations"
    got = {r.check_name: r for r in monitors.monitor_all(checks(runs), results_path=path, as_of=NOW).collect()}
    assert {k: r.status for k, r in got.items()} == {"freshness": "PASS", "broken": "NO_DATA", "unbuilt": "NO_DATA", "rejection_rate": "PASS"}
    assert "cannot be read" in json.loads(got["broken"].details)["error"] and got["freshness"].details is None
    assert json.loads(got["unbuilt"].details)["error_type"] == "AnalysisException"
    monitors.monitor_all(checks(runs), enabled=False, results_path=path, as_of=NOW)
    kept = spark.read.parquet(path)
    assert kept.count() == 8 and kept.select("evaluation_id").distinct().count() == 8
    assert kept.where("status = 'DISABLED'").count() == 4 and {r.evaluated_at for r in kept.collect()} == {NOW}


def test_thresholds_come_from_a_table(spark, runs):
    kinds = "section string, name string, value double"
    t = monitors.thresholds(spark.createDataFrame([("rejection_rate", "fail", 0.05), ("rejection_rate", "warn", 0.01), ("volume", "baseline_window_runs", 3.0)], kinds))
    assert t["rejection_rate"] == {"warn": 0.01, "fail": 0.05} and t["volume"]["baseline_window_runs"] == 3 and t["freshness"] == monitors.THRESHOLDS["freshness"]
    assert monitors.rejection_rate(runs, NOW, **t["rejection_rate"]).first().status == "FAIL"
    with pytest.raises(ValueError, match="no threshold rejection_rate.fial"):
        monitors.thresholds(spark.createDataFrame([("rejection_rate", "fial", 0.1)], kinds))
    assert monitors.THRESHOLDS["rejection_rate"] == {"warn": 0.20, "fail": 0.35}


def test_metrics_carry_labels_and_observed_values(spark, runs):
    got = monitors.monitor_metrics(monitors.monitor_all(checks(runs)), "env-1", "drill").collect()
    assert all(r.labels["environment"] == "env-1" and r.labels["mode"] == "drill" for r in got)
    by = {(r.metric_type, r.labels.get("check_name")): r.value for r in got}
    assert by["monitor/check_status", "broken"] == -1 and by["data/rejection_rate", None] == pytest.approx(0.1)
    assert by["pipeline/last_success_age_seconds", None] == 0


@pytest.mark.parametrize("name", ["latest_run_state", "freshness", "missing_scheduled_run", "volume_deviation", "rejection_rate", "deployment_failure", "rollback_failure", "cost_anomaly"])
def test_the_window_reaches_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = q_ops._checks(spark, SF)[name]()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and ("GreaterThanOrEqual(o_orderdate" in plan or "GreaterThanOrEqual(l_shipdate" in plan)


def test_metric_contract_in_one_pass(spark):
    from lakeward.operators import alerts

    catalog = {"a": {"x": ["1", "2"], "y": ["1"]}, "bare": {}}
    rows = [
        (1, "a", {"x": "1", "y": "1"}), (2, "a", {"x": "3", "z": "1"}), (3, "b", {"x": "1"}), (4, None, {}), (5, "bare", {"q": "1"}),
        (6, "bare", {}), (7, "a", {"x": None, "y": "1"}), (8, "a", None),
    ]
    points = spark.createDataFrame(rows, "ts int, series string, labels map<string,string>")
    found = alerts.metric_contract(points, catalog)
    assert {(r.ts, r.label, r.violation) for r in found.collect()} == {
        (2, "x", "value_outside_set"), (2, "y", "missing_label"), (2, "z", "unexpected_label"), (3, None, "unknown_metric_type"),
        (4, None, "unknown_metric_type"), (5, "q", "unexpected_label"), (7, "x", "value_outside_set"),
        (8, "x", "missing_label"), (8, "y", "missing_label"),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_latest_rows_need_no_sort_of_the_input(spark):
    from lakeward.operators import ops

    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "r1", 1), ("a", t, "r2", 2), ("a", t - dt.timedelta(1), "r9", 3), (None, t, "r3", 4), ("n", None, "r4", 5), ("n", None, "r5", 6)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id string, v int")
    got = ops.latest_by(df, ["k"], ["at", "id"], ["id", "v"])
    assert {tuple(r) for r in got.collect()} == {("a", "r2", 2), (None, "r3", 4), ("n", "r5", 6)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_max(at" in plan and "HashAggregate" in plan and plan.index("Join") < plan.index("partial_max(at")

"""JSON record contracts and audit-row rules on small, hand-made rows."""

import json

from pyspark.sql import functions as F

from lakeward.operators import records


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, line string")


def test_event_versions(spark):
    whole = {"event_id": "e", "event_type": "click"}
    texts = [
        whole,
        {**whole, "schema_version": 1},
        {**whole, "schema_version": True},
        {**whole, "schema_version": "2", "client_app_version": "1"},
        {**whole, "schema_version": 2.0},
        {**whole, "schema_version": "2.0"},
        {**whole, "schema_version": None},
        {**whole, "schema_version": [2]},
        {**whole, "schema_version": 3},
        {**whole, "zeta": 1, "alpha": 2},
        {},
    ]
    got = records.normalize_event_versions(lines(spark, *map(json.dumps, texts), "[1]", "{", "", None)).orderBy("n").collect()
    assert [r.reason for r in got] == [
        None, "unknown_fields", "unknown_fields", None, None, "version_not_an_integer", "version_not_an_integer",
        "version_not_an_integer", "version_unsupported", "unknown_fields", None, *["not_an_object"] * 4,
    ]
    assert [r.schema_version for r in got[:5]] == [1, None, None, 2, 2]
    assert got[1].unknown_fields == "schema_version" and got[9].unknown_fields == "alpha,zeta"
    assert got[3].client_app_version == "1" and got[0].client_app_version is None and got[1].event_id is None


def test_log_contract(spark):
    texts = [
        {"event_type": "load", "severity": "warning", "rows_loaded": "7", "attempt_number": 2.9, "duration_ms": False},
        {"event_type": "load", "severity": "loud", "rows_loaded": "7.5", "colour": 1, "task_id": None},
        {"event_type": "load", "error_message": " Bearer hunter22 ", "details": {"a": "y" * 4000}},
        {"severity": "INFO"},
    ]
    got = records.log_contract(lines(spark, *map(json.dumps, texts), "nonsense")).orderBy("n").collect()
    assert (got[0].severity, got[0].rows_loaded, got[0].attempt_number, got[0].duration_ms) == ("WARNING", 7, 2, 0)
    assert got[0].contract_violations == ""
    assert got[1].severity == "INFO" and got[1].contract_violations == "severity:LOUD,field:colour,type:rows_loaded"
    assert got[2].error_message == "[REDACTED]"
    cut = json.loads(got[2].details)
    assert cut["truncated"] is True and len(cut["preview"]) == 4000
    assert [r.rejected for r in got] == [False, False, False, True, True]


def test_details_and_vocabularies(spark):
    rows = spark.createDataFrame([("{}",), ("x" * 4000,), ("x" * 4001,), (None,)], "d string")
    got = [r.c for r in rows.select(records.capped_details(F.col("d")).alias("c")).collect()]
    assert got[0] is None and got[3] is None and len(got[1]) == 4000 and got[2] == "x" * 3997 + "..."
    events = spark.createDataFrame([(1, "RETRY", 1), (2, "BEGUN", 0), (3, None, None)], "id int, event_type string, attempt int")
    broken = records.vocab_violations(events, ["id"], records.task_event_rules()).collect()
    assert sorted(map(tuple, broken)) == [(2, "attempt"), (2, "event_type"), (3, "attempt"), (3, "event_type")]


def test_rollback_decisions(spark):
    applied = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "migration_id string")
    known = [("old", "m1"), ("mid", "m1"), ("mid", "m2"), ("new", "m1"), ("new", "m2"), ("new", "m3"), ("new", "m9")]
    known = spark.createDataFrame(known, "release string, migration_id string")
    manifest = spark.createDataFrame([("m1", False), ("m2", True)], "migration_id string, breaking boolean")
    got = {r.release: (r.decision, r.newer_applied) for r in records.rollback_eligibility(applied, known, manifest).collect()}
    assert got == {"old": ("BLOCKED_BREAKING", 2), "mid": ("BLOCKED_UNLISTED", 1), "new": ("ELIGIBLE", 0)}


def test_snapshot_retention_and_ids(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert sorted((r.k, r.copies) for r in records.snapshot_diff(a, b).collect()) == [(1, 1), (3, -1)]
    days = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t union all select timestamp_ntz'2024-01-02 00:00:00'")
    assert [records.expired_rows(days, "t", n, "2024-01-02").count() for n in (None, 0, 1)] == [0, 1, 0]
    runs = spark.createDataFrame([("2024-01-02", "--a b//c-", None), ("2024-01-02", "x" * 130, "b\n")], "d string, scheduler_run_id string, given_batch_id string")
    one, two = records.batch_identity(runs.withColumn("processing_date", F.to_date("d"))).orderBy("given_batch_id").collect()
    assert (one.batch_id, one.pipeline_run_id, one.valid) == ("batch-20240102", "batch-run-20240102-a-b-c", True)
    assert not two.valid and two.pipeline_run_id.endswith("-" + "x" * 120)


def test_every_vocabulary_is_held(spark):
    row = spark.createDataFrame([("ABORTED", "PASS", "deploy", "INFO", "OTHER", None)], "status string, ok string, deployment_type string, severity string, check_category string, component string")
    found = lambda rules: {r.violation for r in records.vocab_violations(row, [], rules).collect()}
    assert found(records.run_rules()) == {"status"} and found(records.deployment_rules()) == {"status"}
    assert found(records.quality_rules()) == {"check_category", "status"} and found(records.evaluation_rules()) == {"status"}
    assert found(records.cost_label_rules()) == {"component"}


def test_text_and_truth_values_are_no_numbers(spark):
    rows = spark.createDataFrame([("12", True, 7, 1.5)], "t string, b boolean, n long, x double")
    got = rows.select(*[records.as_number(rows, c).alias(c) for c in rows.columns]).first()
    assert tuple(got) == (None, None, 7.0, 1.5)


def test_long_backfills_need_an_override(spark):
    import pytest

    from lakeward.operators import ops

    loaded = spark.createDataFrame([("2024-01-03",)], "d string").select(F.col("d").cast("date").alias("event_date"))
    assert ops.backfill_calendar(loaded, "2024-01-01", "2024-01-07").count() == 6
    for bad in ({}, {"override": "true"}, {"max_days": 6, "override": False}):
        with pytest.raises(ValueError, match="needs an override"):
            ops.backfill_calendar(loaded, "2024-01-01", "2024-01-08", **bad)
    assert ops.backfill_calendar(loaded, "2024-01-01", "2024-01-08", override=True).count() == 7
    with pytest.raises(ValueError, match="precedes"):
        ops.backfill_calendar(loaded, "2024-01-02", "2024-01-01")

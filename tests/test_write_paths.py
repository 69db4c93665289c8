"""Write paths through real tables: keyed merge, landing across checkpoints, load decisions, lineage, suites."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeward.operators import ingest, lineage, ops, suites, text
from lakeward.operators.ingest import LoadError, merge_into_partitioned_table, write_event_lines
from lakeward.operators.publish import dim_countries
from lakeward.plans.pipeline import Pipeline
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import read_table
from lakeward.streaming.landing import start_landing

SF = "/root/testdata/sf0.001"
KINDS = "event_id string, event_date date, v long"


def d(day):
    return dt.date(2024, 1, day)


@pytest.fixture
def table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lw-merge-"), "fact")
    rows = [("a", d(1), 1), ("c", d(1), 1), ("b", d(2), 1)]
    assert merge_into_partitioned_table(spark, path, spark.createDataFrame(rows, KINDS)) == 2
    return path


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.schema(KINDS).parquet(path).select("event_id", "event_date", "v").collect())


def test_merge_keeps_the_other_rows_of_a_touched_partition(spark, table):
    new = spark.createDataFrame([("a", d(1), 2), ("b", d(1), 2), ("e", d(5), 2)], KINDS)
    assert merge_into_partitioned_table(spark, table, new) == 3
    want = [("a", d(1), 2), ("b", d(1), 2), ("c", d(1), 1), ("e", d(5), 2)]
    assert rows_of(spark, table) == want and not os.path.exists(f"{table}/event_date=2024-01-02")
    assert os.listdir(os.path.dirname(table)) == ["fact"]
    assert merge_into_partitioned_table(spark, table, new) == 2 and rows_of(spark, table) == want
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_merge_reads_its_source_once(spark, table):
    unstable = spark.createDataFrame([("a", d(1))], "event_id string, event_date date").withColumn("v", (F.rand() * 1e12).cast("long"))
    merge_into_partitioned_table(spark, table, unstable)
    merged = rows_of(spark, table)
    assert [r[0] for r in merged] == ["a", "c", "b"] or len(merged) == 3


@pytest.mark.parametrize("kinds,row", [("event_id string, event_date date", ("a", d(1))), (KINDS.replace("v long", "v string"), ("a", d(1), "x"))])
def test_merge_refuses_other_columns(spark, table, kinds, row):
    before = rows_of(spark, table)
    with pytest.raises(LoadError, match="differ"):
        merge_into_partitioned_table(spark, table, spark.createDataFrame([row], kinds))
    assert rows_of(spark, table) == before


def test_merge_refuses_repeated_keys(spark, table):
    with pytest.raises(LoadError, match="more than once"):
        merge_into_partitioned_table(spark, table, spark.createDataFrame([("a", d(1), 2), ("a", d(2), 3)], KINDS))


def test_merge_does_not_overwrite_a_table_it_cannot_read(spark, table):
    damaged = next(f for f in os.listdir(f"{table}/event_date=2024-01-01") if f.endswith(".parquet"))
    for name in (damaged, f".{damaged}.crc"):
        with open(f"{table}/event_date=2024-01-01/{name}", "wb") as f:
            f.write(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says
        merge_into_partitioned_table(spark, table, spark.createDataFrame([("a", d(1), 2)], KINDS))
    assert os.path.exists(f"{table}/event_date=2024-01-02")


def test_landing_loads_each_file_once_whatever_the_checkpoint(spark):
    tmp = tempfile.mkdtemp(prefix="lw-land-")
    raw = raw_events_from_driver(read_table(spark, SF, "events"))
    one = raw.filter(F.col("pipeline_run_id").endswith("0105"))
    two = raw.filter(F.col("pipeline_run_id").endswith("0106"))
    landing, table = os.path.join(tmp, "landing"), os.path.join(tmp, "raw")
    write_event_lines(one, f"{landing}/event_date=2024-01-05/batch_id=b-20240105")
    start_landing(spark, landing, table, f"{tmp}/ck1").awaitTermination()
    write_event_lines(two, f"{landing}/event_date=2024-01-06/batch_id=b-20240106")
    start_landing(spark, landing, table, f"{tmp}/ck2").awaitTermination()  # a fresh checkpoint sees all files again
    write_event_lines(one, f"{tmp}/second/event_date=2024-01-05/batch_id=b-x")
    start_landing(spark, f"{tmp}/second", table, f"{tmp}/ck3").awaitTermination()  # a second folder starts at epoch 0 too
    got = {r.batch_id: r["count"] for r in spark.read.parquet(table).groupBy("batch_id").count().collect()}
    assert got == {"b-20240105": one.count(), "b-20240106": two.count(), "b-x": one.count()}
    dates = {r.processing_date for r in spark.read.parquet(table).select("processing_date").distinct().collect()}
    assert dates == {d(5), d(6)}


def test_landing_takes_up_a_file_that_was_started(spark):
    tmp = tempfile.mkdtemp(prefix="lw-land-")
    raw = raw_events_from_driver(read_table(spark, SF, "events")).filter(F.col("pipeline_run_id").endswith("0105"))
    landing, table = f"{tmp}/landing", f"{tmp}/raw"
    write_event_lines(raw, f"{landing}/batch_id=b-1")
    start_landing(spark, landing, table, f"{tmp}/ck1").awaitTermination()
    log = spark.read.parquet(f"{table}__landed")
    kept = log.filter("state = 'started'").collect()
    path = f"{table}__landed"
    spark.createDataFrame(kept, log.schema).write.mode("overwrite").parquet(path)  # as if it died before 'done'
    start_landing(spark, landing, table, f"{tmp}/ck2").awaitTermination()
    assert spark.read.parquet(table).count() == raw.count()
    half = spark.read.parquet(table).limit(3).collect()
    schema = spark.read.parquet(table).schema
    spark.createDataFrame(half, schema).write.mode("overwrite").partitionBy("event_date").parquet(table)
    spark.createDataFrame(kept, log.schema).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="partial_error"):
        start_landing(spark, landing, table, f"{tmp}/ck3").awaitTermination()


def test_load_decision_falls_back_to_the_default_count(spark):
    exp = spark.createDataFrame([("b1", 0), ("b2", None), ("b3", 0)], "batch_id string, expected_rows long")
    st = spark.createDataFrame([("b1", 50000, 1), ("b2", 10, 1)], "batch_id string, row_count long, distinct_runs long")
    got = {r.batch_id: (r.expected_rows, r.decision) for r in ingest.batch_load_decision(exp, st).collect()}
    assert got == {"b1": (50000, "skip"), "b2": (50000, "partial_error"), "b3": (50000, "load")}
    with pytest.raises(LoadError, match="partial_error': 1"):
        ingest.raise_on_decision(ingest.batch_load_decision(exp, st))


def test_lines_and_comments(spark):
    body = "a\r\t# roles/owner role\x0b   # role roles/editor\r\ngcloud role roles/owner\n"
    df = spark.createDataFrame([(1, body), (2, ""), (3, "\n")], "i long, body string")
    lines = text.text_lines(df, ["i"], "body")
    assert [r.line for r in lines.orderBy("i", "line_no").collect()] == body.splitlines() + [""]
    got = [(r.line_no, r.reason) for r in text.grant_scan(lines, ["i"]).collect()]
    assert got == [(5, "grants prohibited roles/owner")]


def test_migration_states(spark):
    t = dt.datetime(2024, 1, 1)
    kinds = "migration_id string, seq long, migration_checksum string, applied_at timestamp_ntz, status string"
    ledger = spark.createDataFrame([(m, 1, "c", t, s) for m, s in [("a", "APPLIED"), ("f", "FAILED"), ("r", "RUNNING"), ("n", None)]], kinds)
    manifest = spark.createDataFrame([(m, "c") for m in "afrnp"] + [], "migration_id string, checksum string")
    got = {r.migration_id: r.plan_state for r in ops.migration_plan(manifest, ledger).collect()}
    assert got == {"a": "APPLIED", "f": "FAILED_PREVIOUSLY", "r": "FAILED_PREVIOUSLY", "n": "FAILED_PREVIOUSLY", "p": "PENDING"}


def test_edges_from_model_sql(spark):
    sql = """select * from {{ ref("a") }} join {{ source('raw', "b") }} using (x) -- my_ref('no')\n join {{ ref( 'c' ) }} using (y)"""
    got = lineage.edges_from_sql(spark.createDataFrame([("m", sql)], "model string, sql string")).collect()
    assert sorted(map(tuple, got)) == [("a", "m"), ("c", "m"), ("raw.b", "m")]


def test_long_chains_and_cycles(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(100)] + [("100", "98")], "src string, dst string")
    start = spark.createDataFrame([("0", "0")], "src string, dst string")
    assert lineage.reach(edges, start).count() == 101
    owners = spark.createDataFrame([("99", "team"), ("0", "me")], "node string, consumer string")
    changed = spark.createDataFrame([("50",)], "node string")
    got = [tuple(r) for r in lineage.consumer_impact(edges, changed, owners).collect()]
    assert got == [("50", "team", "99")]


def verdicts(p, spark, fact, expected):
    got = suites.warehouse_validation(p.raw, p.classified, p.accepted, p.rejected, fact, p.dim_users, dim_countries(spark), p.mart, expected)
    return {(r.batch_id, r.check_name): r.status for r in got.collect()}


def test_missing_batch_and_global_faults_fail_the_verdict(spark):
    p = Pipeline(spark, SF, materialize=True)
    own = p.raw.filter("batch_id is not null").groupBy("batch_id").agg(F.max("processing_date").alias("expected_date"))
    expected = own.unionByName(spark.createDataFrame([("b-none", d(31))], "batch_id string, expected_date date"))
    good = verdicts(p, spark, p.fact, expected)
    assert good["b-none", "batch_nonempty"] == good["b-none", "overall"] == "FAIL"
    assert good["b-20240105", "overall"] == "PASS"
    wrong_day = own.withColumn("expected_date", F.date_add("expected_date", 1))
    assert verdicts(p, spark, p.fact, wrong_day)["b-20240105", "processing_date_semantics"] == "FAIL"
    doubled = p.fact.unionByName(p.fact.filter("batch_id = 'b-20240107'").limit(1))
    bad = verdicts(p, spark, doubled, expected)
    assert bad[None, "fact_event_ids_unique"] == "FAIL" and bad["b-20240105", "overall"] == "FAIL"

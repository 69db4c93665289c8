"""Versioned tables through crashes, refusals and repairs; contracts; JSON-lines rejects; content-addressed landing."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeward.operators import contracts, ingest
from lakeward.operators.contracts import Contract, ContractError
from lakeward.operators.ingest import LoadError
from lakeward.operators.versioned import VersionedTable, content_hash, fingerprints
from lakeward.plans import q_tables  # noqa: F401
from lakeward.plans.registry import ORACLES, QUERIES
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import DRIVER_TABLES, read_table, table_path
from lakeward.streaming.landing import start_landing

SF = "/root/testdata/sf0.001"
KINDS = "event_id string, event_date date, batch_id string, v long"


def d(day):
    return dt.date(2024, 1, day)


ROWS = [("a", d(1), "x", 1), ("b", d(1), "y", 1), ("c", d(2), "x", 1), ("e", d(3), "y", 1), ("n", None, "y", 1)]


@pytest.fixture
def table(spark):
    t = VersionedTable(spark, os.path.join(tempfile.mkdtemp(prefix="lw-table-"), "fact"), "event_date")
    t.full_refresh(spark.createDataFrame(ROWS, KINDS))
    return t


def rows_of(t, version=None):
    return sorted((tuple(r) for r in t.read(version).collect()), key=str)


def as_sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("key", ["fct_merge", "partial_load_repair", "full_refresh", "additive_columns", "late_backfill",
                                 "quarantine_rewrite", "partition_rebuild", "contract_violations", "jsonl_scan", "landing_conflicts"])
def test_query_matches_oracle(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    df = QUERIES[key](spark, SF)
    cur = con.execute(ORACLES[key])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    got = sorted(str([str(r[c]) for c in cols]) for r in df.collect())
    want = sorted(str([str(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want and got


def test_versions_stay_readable_and_history_is_the_ledger(table, spark):
    table.merge(spark.createDataFrame([("a", d(2), "x", 2), ("z", d(9), "x", 2)], KINDS))
    want = as_sorted([("a", d(2), "x", 2), ("b", d(1), "y", 1), ("c", d(2), "x", 1), ("e", d(3), "y", 1), ("n", None, "y", 1), ("z", d(9), "x", 2)])
    assert rows_of(table) == want and rows_of(table, 1) == as_sorted(ROWS)
    assert [(r.version, r.operation, r.row_count) for r in table.history().orderBy("version").collect()] == [(1, "full_refresh", 5), (2, "merge", 6)]
    got = {r.value: (r.change, r.same_files) for r in table.changes(1, 2).collect()}
    assert got == {
        "2024-01-01": ("changed", False), "2024-01-02": ("changed", False), "2024-01-03": ("unchanged", True), None: ("unchanged", True), "2024-01-09": ("added", False),
    }


def test_a_partition_left_empty_goes(table, spark):
    table.merge(spark.createDataFrame([("c", d(1), "x", 5)], KINDS))
    assert {r.value: r.change for r in table.changes(1).collect()}["2024-01-02"] == "removed"
    table.merge(spark.createDataFrame([("n", d(1), "y", 5)], KINDS))
    assert {r.value for r in table.partition_fingerprints().collect()} == {"2024-01-01", "2024-01-03"}


@pytest.mark.parametrize("row", [(None, d(1), "x", 1)])
def test_merge_refuses_null_keys_and_leaves_nothing_behind(table, spark, row):
    before = sorted(os.listdir(f"{table.path}/data"))
    with pytest.raises(LoadError, match="without event_id"):
        table.merge(spark.createDataFrame([row], KINDS))
    with pytest.raises(LoadError, match="more than once"):
        table.merge(spark.createDataFrame([("q", d(1), "x", 1), ("q", d(2), "x", 1)], KINDS))
    assert sorted(os.listdir(f"{table.path}/data")) == before and table.version().number == 1
    plain = os.path.join(tempfile.mkdtemp(), "t")
    ingest.merge_into_partitioned_table(spark, plain, spark.createDataFrame(ROWS, KINDS))
    with pytest.raises(LoadError, match="without event_id"):
        ingest.merge_into_partitioned_table(spark, plain, spark.createDataFrame([row], KINDS))
    assert os.listdir(os.path.dirname(plain)) == ["t"]


def test_full_refresh_needs_approval(table, spark):
    new = spark.createDataFrame([("q", d(7), "x", 9)], KINDS)
    with pytest.raises(LoadError, match="approved"):
        table.full_refresh(new)
    assert rows_of(table) == as_sorted(ROWS)
    table.full_refresh(new, approved=True)
    assert rows_of(table) == [("q", d(7), "x", 9)] and rows_of(table, 1) == as_sorted(ROWS)


@pytest.mark.parametrize("step", ["_stage", "_commit"])
@pytest.mark.parametrize("change", ["full_refresh", "merge", "repair", "quarantine", "rebuild"])
def test_a_writer_that_dies_leaves_the_table_and_can_run_again(table, spark, monkeypatch, step, change):
    new = spark.createDataFrame([("c", d(2), "x", 7), ("a", d(1), "x", 7)], KINDS)
    run = {
        "full_refresh": lambda: table.full_refresh(new, approved=True),
        "merge": lambda: table.merge(new),
        "repair": lambda: table.replace_batch("x", new, 2),
        "quarantine": lambda: table.quarantine_batch("x"),
        "rebuild": lambda: table.rebuild_partition(d(2), new.where("event_id = 'c'")),
    }[change]
    whole = getattr(VersionedTable, step)

    def dies(self, *a, **k):
        if step == "_stage":
            whole(self, *a, **k)  # the data is there, the writer is not
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, step, dies)
        with pytest.raises(KeyboardInterrupt):
            run()
    assert rows_of(table) == as_sorted(ROWS) and table.version().number == 1
    run()
    after = rows_of(table)
    assert after != as_sorted(ROWS) and table.version().number == 2
    assert table.vacuum(keep_versions=2) >= 1  # what the dead writer left
    assert rows_of(table) == after and rows_of(table, 1) == as_sorted(ROWS)
    table.vacuum(keep_versions=1)
    assert rows_of(table) == after
    with pytest.raises(LoadError, match="no version 1"):
        table.read(1)


def test_of_two_writers_the_second_is_refused(table, spark):
    base = table.version()
    table.quarantine_batch("x")
    write, parts = table._stage(spark.createDataFrame([("q", d(7), "x", 9)], KINDS))
    with pytest.raises(LoadError, match="another writer"):
        table._commit(base, "late", {}, base.schema, parts)
    assert rows_of(table) == as_sorted(r for r in ROWS if r[2] != "x")


def test_repair_counts_before_it_switches(table, spark):
    own = spark.createDataFrame([("a", d(1), "x", 1), ("c", d(2), "x", 1), ("d", d(4), "x", 1)], KINDS)
    with pytest.raises(LoadError, match="2 rows staged, the manifest has 3"):
        table.replace_batch("x", own.where("event_id <> 'd'"), 3)
    with pytest.raises(LoadError, match="stands more than once"):
        table.replace_batch("x", own.unionByName(own), 6)
    with pytest.raises(LoadError, match="not all of batch"):
        table.replace_batch("x", own.withColumn("batch_id", F.lit("y")), 3)
    assert rows_of(table) == as_sorted(ROWS)
    table.replace_batch("x", own, 3)
    once = rows_of(table)
    assert once == as_sorted([r for r in ROWS if r[2] == "y"] + [("a", d(1), "x", 1), ("c", d(2), "x", 1), ("d", d(4), "x", 1)])
    table.replace_batch("x", own, 3)  # again: the same table
    assert rows_of(table) == once and {r.change for r in table.changes(2, 3).collect()} == {"unchanged"}


def test_repair_refuses_to_change_other_batches(table, monkeypatch, spark):
    own = spark.createDataFrame([("a", d(1), "x", 1), ("e2", d(3), "x", 1)], KINDS)
    good = VersionedTable._stage

    def stage_less(self, rows):
        return good(self, rows.where("event_id <> 'e'"))

    monkeypatch.setattr(VersionedTable, "_stage", stage_less)
    with pytest.raises(LoadError, match="other batches would change"):
        table.replace_batch("x", own, 2)
    assert rows_of(table) == as_sorted(ROWS)


def test_rebuild_refuses_rows_of_other_partitions(table, spark):
    with pytest.raises(LoadError, match="outside the change"):
        table.rebuild_partition(d(1), spark.createDataFrame(ROWS, KINDS))
    assert rows_of(table) == as_sorted(ROWS)


def test_columns_are_added_but_never_retyped_or_dropped(table, spark):
    wide = spark.createDataFrame([("a", d(1), "x", 2, "new")], KINDS + ", channel string")
    with pytest.raises(LoadError, match="added"):
        table.merge(wide)
    with pytest.raises(LoadError, match="v is string, not bigint"):
        table.merge(wide.withColumn("v", F.col("v").cast("string")), add_columns=True)
    with pytest.raises(LoadError, match="v is missing"):
        table.merge(wide.drop("v"), add_columns=True)
    table.merge(wide, add_columns=True)
    assert {(r.event_id, r.channel) for r in table.read().collect()} == {("a", "new"), ("b", None), ("c", None), ("e", None), ("n", None)}
    assert {r.value: r.change for r in table.changes(1).collect()} == {"2024-01-01": "changed", "2024-01-02": "unchanged", "2024-01-03": "unchanged", None: "unchanged"}
    with pytest.raises(LoadError, match="channel is missing"):
        table.quarantine_batch("x") and table.merge(spark.createDataFrame([("a", d(1), "x", 2)], KINDS))


def test_fingerprints_see_moved_values_and_ignore_added_null_columns(spark):
    one = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    two = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    wide = one.withColumn("c", F.lit(None).cast("string"))
    f = lambda x: tuple(fingerprints(x).first())
    assert f(one) != f(two) and f(one) == f(wide)
    assert one.select(content_hash(one).alias("h")).distinct().count() == 1


# contracts

SMALL = Contract("small", (("event_id", "string", False), ("event_date", "date", False), ("batch_id", "string", True), ("v", "bigint", True)))


def test_every_writer_refuses_what_breaks_its_contract(spark):
    tmp = tempfile.mkdtemp(prefix="lw-contract-")
    t = VersionedTable(spark, f"{tmp}/t", "event_date", SMALL)
    with pytest.raises(ContractError, match="v: missing_column"):
        t.full_refresh(spark.createDataFrame([("a", d(1), "x")], "event_id string, event_date date, batch_id string"))
    with pytest.raises(Exception, match="contract small: event_id is NULL"):
        t.full_refresh(spark.createDataFrame([(None, d(1), "x", 1)], KINDS))
    assert t.version() is None
    t.full_refresh(spark.createDataFrame([("a", d(1), "x", 1)], KINDS))
    for write in (lambda x: t.merge(x), lambda x: t.replace_batch("x", x, 2), lambda x: t.rebuild_partition(d(1), x)):
        with pytest.raises(Exception, match="event_date is NULL|outside the change"):
            write(spark.createDataFrame([("b", None, "x", 1), ("c", d(1), "x", 1)], KINDS))
    assert rows_of(t) == [("a", d(1), "x", 1)]
    raw = raw_events_from_driver(read_table(spark, SF, "events"))
    with pytest.raises(ContractError, match="source_file: missing_column"):
        ingest.append_raw(raw.drop("source_file"), f"{tmp}/raw")
    with pytest.raises(Exception, match="contract raw_events: source_file is NULL"):
        ingest.append_raw(raw.withColumn("source_file", F.lit(None).cast("string")), f"{tmp}/raw")
    ingest.append_raw(raw, f"{tmp}/raw2")
    assert spark.read.parquet(f"{tmp}/raw2").count() == raw.count()


def test_row_violations_name_row_and_column(spark):
    rows = spark.createDataFrame([("a", None, None, 1), (None, None, "x", 1), ("c", d(1), "x", 1)], KINDS)
    got = contracts.row_violations(rows, SMALL, F.col("v")).collect()
    assert sorted(r.column_name for r in got) == ["event_date", "event_date", "event_id"]
    assert contracts.violation_counts(rows.where("event_id = 'c'"), SMALL).count() == 0


# JSON lines


def test_scan_keeps_bad_lines_aside(spark):
    good = '{"event_id":"1","event_name":"view","event_timestamp":"2024-01-05T01:02:03.123456","event_date":"2024-01-05","extra":1}'
    lines = [good, "", "   ", "{", "[1]", "null", '"text"', good.replace('"view"', "null"), good.replace("2024-01-05T01", "never"), '{"event_id":"1"}']
    got = ingest.scan_event_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, i int")).orderBy("i").collect()
    assert [(r.i, r.reject_reason) for r in got] == [
        (0, None), (3, "malformed_json"), (4, "malformed_json"), (5, "malformed_json"), (6, "malformed_json"), (7, "missing_event_name"),
        (8, "malformed_json"), (9, "missing_event_name"),
    ]
    assert got[0].event_timestamp == dt.datetime(2024, 1, 5, 1, 2, 3, 123456) and got[0].reject_line is None and got[1].reject_line == "{"


def test_a_bad_line_does_not_stop_its_batch(spark):
    tmp = tempfile.mkdtemp(prefix="lw-rejects-")
    raw = raw_events_from_driver(read_table(spark, SF, "events")).filter(F.col("pipeline_run_id").endswith("0105"))
    folder = f"{tmp}/landing/event_date=2024-01-05/batch_id=b-1"
    ingest.write_event_lines(raw, folder)
    with open(f"{folder}/part-bad.json", "w") as f:
        f.write('{"event_id": "cut off\n{"event_id": "x"}\n')
    for checkpoint in ("ck1", "ck2"):  # a fresh checkpoint sees all files again
        start_landing(spark, f"{tmp}/landing", f"{tmp}/raw", f"{tmp}/{checkpoint}").awaitTermination()
        assert spark.read.parquet(f"{tmp}/raw").count() == raw.count()
        rejects = spark.read.parquet(f"{tmp}/raw__rejects").collect()
        assert sorted(r.reject_reason for r in rejects) == ["malformed_json", "missing_event_name"]
    back = spark.read.parquet(f"{tmp}/raw").select("event_id", "event_timestamp", "user_id")
    assert back.exceptAll(raw.select(*back.columns)).isEmpty()  # times to the microsecond


# landing by content


def test_land_once(spark):
    tmp = tempfile.mkdtemp(prefix="lw-once-")
    raw = raw_events_from_driver(read_table(spark, SF, "events")).filter(F.col("pipeline_run_id").endswith("0105"))
    path, ledger = f"{tmp}/landing/batch_id=b-1", f"{tmp}/ledger"
    assert ingest.land_once(raw, path, ledger) == "landed"
    assert ingest.land_once(raw.repartition(3), path, ledger) == "reused"
    for other in (raw.limit(3), raw.withColumn("app_version", F.lit("9"))):
        with pytest.raises(LoadError, match="other content"):
            ingest.land_once(other, path, ledger)
    assert spark.read.json(path).count() == raw.count() and spark.read.parquet(ledger).count() == 1
    assert ingest.land_once(raw, path, f"{tmp}/ledger2") == "reused"  # died before its entry: the files tell
    assert spark.read.parquet(f"{tmp}/ledger2").count() == 1
    assert os.listdir(f"{tmp}/landing") == ["batch_id=b-1"]


def test_fact_scan_counts_every_day(spark):
    folder = tempfile.mkdtemp(prefix="lw-scan-")
    days = [dt.datetime(2024, 1, d, 9) for d in (1, 9, 10, 11, 12, 13, 31)] + [dt.datetime(2023, 12, 5, 9), None]
    rows = [(1000 + 400 * i, t, 5, kind) for i, (t, kind) in enumerate((t, kind) for t in days for kind in ("view", "click"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(table_path(folder, "events"))
    want = q_tables.fact(spark, folder).groupBy("event_name", "country_code").count().collect()
    got = QUERIES["perf_fact_scan"](spark, folder).collect()
    assert as_sorted(got) == as_sorted(want)
    assert sum(r.events for r in got) > sum(t is not None and 10 <= t.day <= 12 for t in days) * 2
    assert any(r.event_date is None for r in q_tables.fact(spark, folder).collect())

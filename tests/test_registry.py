"""Registered queries vs their DuckDB oracles on the smallest tables, plus
plan-shape assertions for the core query."""

import duckdb
import pytest

import __spark_entry__ as ent
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.registry import ORACLES, QUERIES, load_all
from lakeward.sources.tables import DRIVER_TABLES, table_path

SF = "/root/testdata/sf0.001"
KEYS = [
    "classify_events", "daily_event_mart", "raw_validation", "warehouse_validation", "recon_violations",
    "monitor_all", "cost_weekly", "alert_incidents", "lineage_closure", "fct_merge", "audit_upsert", "batch_metrics",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


def norm(v):
    return str(round(v, 6)) if isinstance(v, float) else (str(v) if v is not None else "<null>")


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = ent.queries()[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ent.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


NO_ORACLE = set()


def test_every_query_has_an_oracle():
    load_all()
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE


def test_entry_runs(spark):
    assert ent.entry(spark).count() > 0


def test_one_exchange_for_both_dedup_windows(spark):
    plan = Pipeline(spark, SF, hot_event_ids=None).classified._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(event_id") == 1
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan

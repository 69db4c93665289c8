"""Queries that SQL can express, against DuckDB over the whole smallest tables."""

import duckdb
import pytest

from lakeward.llm import queries
from lakeward.sources.tables import DRIVER_TABLES, table_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    df = queries.QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want

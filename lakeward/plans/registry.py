"""Registry of named queries (key -> Spark plan) and their DuckDB oracles.

Every query reads the driver tables (or data Spark derives from them) in full;
``now``-valued audit columns are left out of the compared outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from lakeward.plans import (  # noqa: F401
        q_core,
        q_suites,
        q_ops,
        q_ops2,
        q_text,
        q_alerts,
        q_ingest,
        q_lineage,
        q_ledger,
        q_records,
        q_tables,
        q_recovery,
    )

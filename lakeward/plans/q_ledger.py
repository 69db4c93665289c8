"""Registered queries: migration ledger (latest state, history, plan)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeward.operators import ops
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table


def ledger(spark, d):
    """part -> schema_migrations ledger: one applied/failed attempt per part,
    migration = brand, checksum = md5 of the part type."""
    p = read_table(spark, d, "part")
    return p.select(
        F.col("p_brand").alias("migration_id"),
        F.col("p_partkey").alias("seq"),
        F.md5(F.col("p_type")).alias("migration_checksum"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("p_partkey").cast("int"))).alias(
            "applied_at"
        ),
        F.when(F.col("p_size") < 5, "FAILED").when(F.col("p_size") < 9, "RUNNING").when(F.col("p_size") < 40, "APPLIED").alias("status"),
    )


O_LEDGER = """WITH ledger AS (
  SELECT p_brand AS migration_id, p_partkey AS seq, md5(p_type) AS migration_checksum,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)) AS applied_at,
         CASE WHEN p_size < 5 THEN 'FAILED' WHEN p_size < 9 THEN 'RUNNING' WHEN p_size < 40 THEN 'APPLIED' END AS status
  FROM part),
latest AS (
  SELECT migration_id, arg_max(migration_checksum, (applied_at, seq)) AS migration_checksum,
         arg_max_null(status, (applied_at, seq)) AS status, max(applied_at) AS applied_at
  FROM ledger GROUP BY 1)
"""


@query("ledger_latest", O_LEDGER + "SELECT * FROM latest")
def q_ledger_latest(spark, d):
    return ops.ledger_latest(ledger(spark, d))


@query("ledger_history", O_LEDGER + "SELECT migration_id, seq, status, applied_at FROM ledger ORDER BY applied_at, seq")
def q_ledger_history(spark, d):
    return ledger(spark, d).select("migration_id", "seq", "status", "applied_at").orderBy("applied_at", "seq")


@query(
    "migration_plan",
    O_LEDGER
    + """, manifest AS (SELECT p_brand AS migration_id, md5(max(p_type)) AS checksum FROM part GROUP BY 1
                        UNION ALL SELECT 'Brand#99', md5('next'))
    SELECT m.migration_id,
      CASE WHEN l.applied_at IS NULL THEN 'PENDING' WHEN l.status IS DISTINCT FROM 'APPLIED' THEN 'FAILED_PREVIOUSLY'
           WHEN l.migration_checksum != m.checksum THEN 'CHECKSUM_MISMATCH' ELSE 'APPLIED' END AS plan_state
    FROM manifest m LEFT JOIN latest l USING (migration_id)""",
)
def q_migration_plan(spark, d):
    """Manifest = one migration per brand (checksum of its greatest type) plus
    one not yet applied migration."""
    p = read_table(spark, d, "part")
    manifest = p.groupBy(F.col("p_brand").alias("migration_id")).agg(F.md5(F.max("p_type")).alias("checksum")).unionByName(
        spark.createDataFrame([("Brand#99", None)], "migration_id string, checksum string").select(
            "migration_id", F.md5(F.lit("next")).alias("checksum")
        )
    )
    return ops.migration_plan(manifest, ledger(spark, d))

"""Registered queries: load state/decision, fingerprints, incremental fact,
quarantine, partition fingerprints, keyed upsert."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeward.operators import ingest, publish
from lakeward.plans.oracle import FACT_COLS, with_core
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.q_ops import O_RUNS, runs, w
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table

SPLIT_AT = dt.datetime(2024, 1, 16)  # target fact = accepted rows ingested before this instant


@query(
    "batch_load_state",
    with_core("SELECT batch_id, count(*) AS row_count, count(DISTINCT pipeline_run_id) AS distinct_runs FROM raw GROUP BY 1"),
)
def q_batch_load_state(spark, d):
    return ingest.batch_load_state(Pipeline(spark, d).raw)


@query(
    "batch_load_decision",
    with_core(
        """SELECT e.batch_id, e.expected_rows::BIGINT AS expected_rows, coalesce(s.row_count, 0) AS row_count,
             CASE WHEN coalesce(s.row_count, 0) = 0 THEN 'load' WHEN s.row_count = e.expected_rows THEN 'skip'
                  WHEN s.row_count < e.expected_rows THEN 'partial_error' ELSE 'conflicting_error' END AS decision
           FROM (SELECT batch_id, if(right(batch_id, 1) = '7', 50000, n) AS expected_rows FROM
                 (SELECT 'b-' || strftime(ts, '%Y%m%d') AS batch_id, count(*) AS n FROM events
                  WHERE event_id % 97 != 8 GROUP BY 1
                  UNION ALL SELECT 'b-20240131', 1)) e
           LEFT JOIN (SELECT batch_id, count(*) AS row_count FROM raw GROUP BY 1) s USING (batch_id)"""
    ),
)
def q_batch_load_decision(spark, d):
    """Expected rows per daily batch = that day's generated events (legacy
    rows carry no batch); one extra expected batch with no landed rows shows
    the ``load`` decision."""
    ev = read_table(spark, d, "events")
    expected = (
        ev.filter(F.col("event_id") % 97 != 8)
        .groupBy(F.concat(F.lit("b-"), F.date_format("ts", "yyyyMMdd")).alias("batch_id"))
        .agg(F.count(F.lit(1)).alias("expected_rows"))
        .unionByName(spark.createDataFrame([("b-20240131", 1)], "batch_id string, expected_rows bigint"))
    )
    day = F.substring("batch_id", -2, 2)  # days 7 and 27 name no count, day 17 names 0
    unknown = F.when(day == "17", F.lit(0)).cast("bigint")
    expected = expected.withColumn("expected_rows", F.when(day.endswith("7"), unknown).otherwise(F.col("expected_rows")))
    return ingest.batch_load_decision(expected, ingest.batch_load_state(Pipeline(spark, d).raw))


@query(
    "batch_fingerprint",
    with_core(
        """SELECT batch_id, count(*) AS row_count, bit_xor(raw_record_hash) AS hash_xor,
             CAST(sum(CAST(raw_record_hash AS DECIMAL(38,0))) AS VARCHAR) AS hash_sum FROM stg GROUP BY 1"""
    ),
)
def q_batch_fingerprint(spark, d):
    return ingest.batch_fingerprint(Pipeline(spark, d).stg, "batch_id", "raw_record_hash")


@query(
    "partition_fingerprints",
    with_core(
        """SELECT event_date, count(*) AS row_count, bit_xor(raw_record_hash) AS hash_xor,
             CAST(sum(CAST(raw_record_hash AS DECIMAL(38,0))) AS VARCHAR) AS hash_sum FROM fact GROUP BY 1"""
    ),
)
def q_partition_fingerprints(spark, d):
    return ingest.batch_fingerprint(Pipeline(spark, d).fact, "event_date", "raw_record_hash")


LOOKBACK_CTE = """tgt AS (SELECT * FROM fact WHERE ingested_at < TIMESTAMP '2024-01-16 00:00:00'),
src AS (SELECT * FROM fact WHERE ingested_at >=
        coalesce((SELECT max(ingested_at) FROM tgt), TIMESTAMP '1970-01-01') - INTERVAL 3 DAY)"""


@query("fct_lookback", with_core("SELECT * FROM src", LOOKBACK_CTE))
def q_fct_lookback(spark, d):
    p = Pipeline(spark, d)
    fact = p.fact.drop("loaded_to_core_at", "updated_at")
    target = fact.filter(F.col("ingested_at") < F.lit(SPLIT_AT).cast("timestamp_ntz"))
    return publish.lookback_source(fact, target.agg(F.max("ingested_at")).first()[0])


@query(
    "fct_backfill",
    with_core(f"SELECT {FACT_COLS} FROM fact WHERE event_date >= DATE '2024-01-10' AND event_date <= DATE '2024-01-12'"),
)
def q_fct_backfill(spark, d):
    p = Pipeline(spark, d)
    return publish.backfill_window(p.fact.drop("loaded_to_core_at", "updated_at"), "2024-01-10", "2024-01-12")


@query(
    "quarantine_batch",
    with_core(
        """SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, count(*) AS row_count FROM raw
           WHERE batch_id IS NULL OR batch_id != 'b-20240105' GROUP BY 1"""
    ),
)
def q_quarantine_batch(spark, d):
    """Raw rows left per batch after quarantining one batch: the batch is gone,
    every other batch is unchanged."""
    raw = ingest.quarantine_batch(Pipeline(spark, d).raw, "b-20240105")
    return raw.groupBy(F.coalesce("batch_id", "pipeline_run_id").alias("batch_scope")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "audit_upsert",
    w(O_RUNS)
    + """, tgt AS (SELECT * FROM runs WHERE started_at < TIMESTAMP '2000-01-01 00:00:00'),
    src AS (SELECT pipeline_run_id, batch_id, processing_date, started_at + INTERVAL 1 HOUR AS started_at, completed_at,
              CASE WHEN status = 'RUNNING' THEN 'SUCCESS' ELSE status END AS status, attempt_number + 1 AS attempt_number,
              rows_loaded, rows_accepted, rows_rejected, environment
            FROM runs WHERE started_at >= TIMESTAMP '1999-07-01 00:00:00')
    SELECT coalesce(t.pipeline_run_id, s.pipeline_run_id) AS pipeline_run_id,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.batch_id ELSE t.batch_id END AS batch_id,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.processing_date ELSE t.processing_date END AS processing_date,
      coalesce(t.started_at, s.started_at) AS started_at,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.completed_at ELSE t.completed_at END AS completed_at,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.status ELSE t.status END AS status,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.attempt_number ELSE t.attempt_number END AS attempt_number,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.rows_loaded ELSE t.rows_loaded END AS rows_loaded,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.rows_accepted ELSE t.rows_accepted END AS rows_accepted,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.rows_rejected ELSE t.rows_rejected END AS rows_rejected,
      CASE WHEN s.pipeline_run_id IS NOT NULL THEN s.environment ELSE t.environment END AS environment,
      CASE WHEN t.pipeline_run_id IS NULL THEN TIMESTAMP '2001-09-01 00:00:00' ELSE TIMESTAMP '2000-01-01 00:00:00' END AS created_at,
      CASE WHEN s.pipeline_run_id IS NULL THEN TIMESTAMP '2000-01-02 00:00:00' ELSE TIMESTAMP '2001-09-01 00:00:00' END AS updated_at
    FROM tgt t FULL JOIN src s ON t.pipeline_run_id = s.pipeline_run_id""",
)
def q_audit_upsert(spark, d):
    """pipeline_runs upsert: runs started before 2000 are the table; a later
    batch of records re-reports runs from mid-1999 on (status and attempt
    advance, started_at re-sent one hour later) plus new runs. Matches keep
    started_at and created_at and are updated now; rows not sent again stay as they were."""
    r = runs(spark, d)
    target = r.filter(F.col("started_at") < F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz"))
    source = r.filter(F.col("started_at") >= F.lit(dt.datetime(1999, 7, 1)).cast("timestamp_ntz")).select(
        "pipeline_run_id", "batch_id", "processing_date",
        (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("started_at"), "completed_at",
        F.when(F.col("status") == "RUNNING", "SUCCESS").otherwise(F.col("status")).alias("status"),
        (F.col("attempt_number") + 1).alias("attempt_number"), "rows_loaded", "rows_accepted", "rows_rejected",
        "environment",
    )
    at = lambda *day: F.lit(dt.datetime(*day)).cast("timestamp_ntz")
    target = target.withColumns({"created_at": at(2000, 1, 1), "updated_at": at(2000, 1, 2)})
    return ingest.keyed_upsert(target, source, ["pipeline_run_id"], keep_on_match=("started_at",), now=dt.datetime(2001, 9, 1))

"""Streaming landing: JSONL batches dropped under ``landing/`` are appended to
the raw table, each file once.

``readStream`` of text lines, parsed against the line schema -> ``foreachBatch``:
lines that are no events go to a reject table beside the raw one, a load decision
is taken per file, load metadata is added (the processing date is the one in the
file's path, so late files keep their date), and events are appended partitioned
by event_date. A bad line never stops the lines around it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators.ingest import (
    append_raw,
    batch_load_decision,
    enrich,
    raise_on_decision,
    scan_event_lines,
    split_scan,
    table_exists,
)


def landing_stream(spark: SparkSession, landing_dir: str) -> DataFrame:
    """Streaming JSONL scan; batch id comes from the ``batch_id=`` path segment."""
    lines = spark.readStream.schema("value string").text(landing_dir)
    path = F.input_file_name()
    lines = lines.select("value", path.alias("source_file"), F.nullif(F.regexp_extract(path, r"batch_id=([^/]+)", 1), F.lit("")).alias("batch_id"))
    return scan_event_lines(lines)


def _ledger(spark: SparkSession, raw_table: str) -> DataFrame:
    path = f"{raw_table.rstrip('/')}__landed"
    kinds = "source_file string, batch_id string, expected_rows bigint, state string"
    return spark.read.schema(kinds).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], kinds)


def _append_batch(raw_table: str):
    """Append the files of a micro-batch that are not in the table yet.

    A file is known by its batch id and path. A ledger beside the table has a
    ``started`` row for each before the append and a ``done`` row after it: done
    files are skipped whatever the epoch or checkpoint; for files started but not
    done the table itself is counted, and the load decision says whether to load,
    skip or stop."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch, rejects = split_scan(batch)
        if not rejects.isEmpty():
            # by file and replaced whole, so a batch that is run again writes the same rejects over itself
            rejects.withColumn("file", F.md5("source_file")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "file"
            ).parquet(f"{raw_table.rstrip('/')}__rejects")
        log = _ledger(spark, raw_table)
        files = batch.groupBy("source_file", "batch_id").agg(F.count(F.lit(1)).alias("expected_rows"))
        files = files.join(log.filter("state = 'done'"), "source_file", "left_anti").cache()
        try:
            started = files.join(log.filter("state = 'started'"), "source_file", "left_semi")
            load = files
            if not started.isEmpty():
                there = spark.read.parquet(raw_table) if table_exists(spark, raw_table) else batch.limit(0)
                state = there.groupBy(F.col("source_file").alias("batch_id")).agg(F.count(F.lit(1)).alias("row_count"))
                expected = files.select(F.col("source_file").alias("batch_id"), "expected_rows")
                decided = batch_load_decision(expected, state)
                raise_on_decision(decided)
                load = files.join(
                    decided.filter("decision = 'load'").select(F.col("batch_id").alias("source_file")), "source_file", "left_semi"
                )
            ledger_path = f"{raw_table.rstrip('/')}__landed"
            files.withColumn("state", F.lit("started")).write.mode("append").parquet(ledger_path)
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            rows = batch.join(load.select("source_file"), "source_file", "left_semi")
            day = F.coalesce(
                F.try_to_date(F.nullif(F.regexp_extract("source_file", r"(?:processing_date|event_date)=([0-9-]+)", 1), F.lit(""))),
                F.to_date(F.lit(now)),
            )
            out = enrich(
                rows, ingested_at=now, source_file=F.col("source_file"), batch_id=F.col("batch_id"), processing_date=day,
                pipeline_run_id=F.concat(F.lit("stream-"), F.substring(F.md5("source_file"), 1, 12)),
            )
            append_raw(out, raw_table)
            files.withColumn("state", F.lit("done")).write.mode("append").parquet(ledger_path)
        finally:
            files.unpersist()

    return run


def start_landing(spark: SparkSession, landing_dir: str, raw_table: str, checkpoint: str, available_now: bool = True):
    w = landing_stream(spark, landing_dir).writeStream.foreachBatch(_append_batch(raw_table)).option(
        "checkpointLocation", checkpoint
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

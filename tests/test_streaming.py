"""Streaming alerts and landing agree with their batch forms."""

import os
import tempfile

from pyspark.sql import functions as F

from lakeward.operators import alerts
from lakeward.operators.ingest import required_field_violations, write_event_lines
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import read_table
from lakeward.streaming import alerts as salerts
from lakeward.streaming.landing import start_landing

SF = "/root/testdata/sf0.001"


def test_streaming_breaches_match_batch(spark):
    tmp = tempfile.mkdtemp(prefix="lw-stream-")
    src = os.path.join(tmp, "points")
    pts = alerts.metric_points_from_events(read_table(spark, SF, "events")).drop("labels")
    pts.write.parquet(src)
    stream = spark.readStream.schema(pts.schema).parquet(src)
    q = (
        salerts.aligned_breaches(stream, 60.0).writeStream.outputMode("update").format("memory")
        .queryName("breaches_t").option("checkpointLocation", os.path.join(tmp, "ck")).start()
    )
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT series, window_start, max_value FROM breaches_t").collect()}
    want = {tuple(r) for r in alerts.threshold_breaches(alerts.align_max(pts, 600), 60.0).collect()}
    assert got == want and len(want) > 0


def test_streaming_landing_appends_once(spark):
    tmp = tempfile.mkdtemp(prefix="lw-land-")
    raw = raw_events_from_driver(read_table(spark, SF, "events")).filter(F.col("pipeline_run_id").endswith("0105"))
    landing = os.path.join(tmp, "landing")
    write_event_lines(raw, os.path.join(landing, "event_date=2024-01-05", "batch_id=b-20240105"))
    table, ck = os.path.join(tmp, "raw"), os.path.join(tmp, "ck")
    start_landing(spark, landing, table, ck).awaitTermination()
    start_landing(spark, landing, table, ck).awaitTermination()  # restart: nothing new, nothing duplicated
    out = spark.read.parquet(table)
    assert out.count() == raw.count()
    assert out.filter(F.col("batch_id") == "b-20240105").count() == raw.count()
    assert required_field_violations(out).count() == 0


def test_streaming_incidents_match_batch(spark):
    tmp = tempfile.mkdtemp(prefix="lw-inc-")
    src = os.path.join(tmp, "points")
    pts = alerts.metric_points_from_events(read_table(spark, SF, "events")).drop("labels")
    pts.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(pts.schema).parquet(src)
    columns = ["series", "opened_at", "closed_at", "breach_points", "peak_value"]
    q = (
        salerts.incident_sessions(stream, 60.0).select(*columns).writeStream.outputMode("complete").format("memory")
        .queryName("incidents_t").option("checkpointLocation", os.path.join(tmp, "ck")).start()
    )
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("incidents_t").collect()}
    want = {tuple(r) for r in alerts.incidents(pts, 60.0).select(*columns).collect()}
    assert got == want and len(want) > 0

"""The hot-group rank path equals the plain window on a skewed input."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeward.operators.classify import classify_events, rank_duplicates
from lakeward.operators.ranking import detect_hot_keys, range_row_number, split_hot
from lakeward.operators.staging import stage_events
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def skewed_raw(spark):
    """Driver events where one event id is copied many times (a hot group)."""
    ev = read_table(spark, SF, "events")
    hot = ev.filter(F.col("event_id") < 400).withColumn("event_id", F.lit(7).cast("long"))
    return raw_events_from_driver(ev.unionByName(hot))


def test_range_row_number_matches_window(spark):
    df = skewed_raw(spark)
    order = [F.col("ingested_at").desc(), F.col("source_file").desc(), F.col("event_timestamp").desc(), F.col("user_id").desc()]
    w = Window.partitionBy("event_id").orderBy(*order)
    want = df.withColumn("rn", F.row_number().over(w))
    got = range_row_number(df, ["event_id"], order, "rn")
    key = ["event_id", "ingested_at", "source_file", "event_timestamp", "user_id", "rn"]
    assert sorted(map(tuple, want.select(key).collect())) == sorted(map(tuple, got.select(key).collect()))


def test_detect_finds_the_hot_id(spark):
    stg = stage_events(skewed_raw(spark))
    hot = detect_hot_keys(stg, ["event_id"], task_rows=100, fraction=1.0)
    assert [r.event_id for r in hot.collect()] == ["7"]


def test_a_null_id_can_be_hot(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 99)], "event_id string, v int")
    hot = detect_hot_keys(df, ["event_id"], task_rows=20, fraction=1.0)
    normal, large = split_hot(df, hot, ["event_id"])
    assert [r.event_id for r in hot.collect()] == [None] and large.count() == 50 and normal.count() == 1


def test_hot_rows_part_before_any_exchange(spark):
    """On the default arguments: the hot id's rows are filtered on the scan and never hashed by event id."""
    stg = stage_events(skewed_raw(spark))
    hot = spark.createDataFrame([("7",)], "event_id string")
    normal, large = split_hot(stg, hot, ["event_id"])
    for part in (normal, large):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(event_id" not in plan.split("BroadcastExchange")[0]
    task_rows = normal.repartition(8, "event_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert task_rows < large.count()


def test_classification_same_with_and_without_skew_path(spark):
    stg = stage_events(skewed_raw(spark))
    hot = spark.createDataFrame([("7",)], "event_id string")
    cols = ["event_id", "source_file", "ingested_at", "event_timestamp", "raw_record_hash",
            "within_batch_duplicate_rank", "duplicate_rank", "rejection_reason"]
    a = classify_events(stg, hot_event_ids=None).select(cols).collect()
    b = classify_events(stg, hot_event_ids=hot).select(cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert any(r.event_id == "7" and r.duplicate_rank > 100 for r in b)

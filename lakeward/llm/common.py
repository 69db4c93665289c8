"""Helpers shared by the training-data operators.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere: maximal runs of anything but ASCII
blanks. A document row is known by ``(_id, _key)``: its ``doc_id`` (may be null)
and an XXH64 over all its columns, so repeated ids and repeated rows stay apart
or together on purpose, never by accident.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.session import ensure_checkpoint_dir

WS = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the cluster's shared checkpoint folder and read it back.

    Cuts lineage and survives lost executors; also gives later joins a real size
    to choose broadcast or shuffle by.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*[col(c) for c in docs.columns])


def text_of(name: str = "text") -> Column:
    return F.coalesce(col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def spaced(text: Column) -> Column:
    """Every white-space run becomes one space; runs that already are one are not matched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def positions(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``_pos``: the 0-based place of each row in its group, under ``order``.

    A global range sort spreads even one huge group over many tasks; only one
    count per (task, group) is summed up across tasks. ``order`` may tie: tied
    rows are split arbitrarily but each place is given once. ``df`` should be
    cheap to read twice (the range partitioner samples it).
    """
    keys = [col(g) for g in group]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = (
        tied.repartitionByRange(*keys, *order, F.col("_tie"))
        .sortWithinPartitions(*keys, *order, F.col("_tie"))
        .drop("_tie")
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    placed = materialise(placed, name).withColumns(
        {"_task": F.shiftright("_seq", 33), "_at": F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    runs = placed.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_task").alias("_r_task"),
        *[col(g).alias(f"_r_{g}") for g in group],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_task") == F.col("_r_task")
    for g in group:
        same = same & col(g).eqNullSafe(col(f"_r_{g}"))
    return placed.join(runs, same).select(
        *[col(c) for c in df.columns], (F.col("_at") + F.col("_shift")).alias("_pos")
    )


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """One copy of each distinct row of ``docs`` whose ``(_id, _key)`` is in ``decided``.

    ``decided`` has one row per key; its further columns come along beside
    ``_row`` (the document as a struct). Identical rows collapse before the
    shuffle, so a row repeated any number of times costs one row per task.
    """
    rows = docs.select(
        col("doc_id").alias("_id"), row_key(docs).alias("_key"), F.struct(*[col(c) for c in docs.columns]).alias("_row")
    ).dropDuplicates(["_id", "_key"])
    d = decided.withColumnsRenamed({"_id": "_d_id", "_key": "_d_key"})
    return rows.join(d, (F.col("_key") == F.col("_d_key")) & F.col("_id").eqNullSafe(F.col("_d_id"))).drop(
        "_id", "_key", "_d_id", "_d_key"
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, root``: the smallest node reachable over the links ``u, v`` (longs), for every linked node.

    Rounds of least neighbour label plus one pointer jump, each written as a
    table; only "did anything change" reaches the driver.
    """
    both = materialise(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).distinct(), f"{name}-links")
    label = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
    label = materialise(label.select("node", F.least("node", "v").alias("root")), f"{name}-0")
    while True:
        seen = label.select(F.col("node").alias("v"), "root")
        near = both.join(seen, "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        step = materialise(step, f"{name}-step")
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        label = step.join(up, "new", "left").select(
            "node", "old", F.least("new", F.coalesce("up", "new")).alias("root")
        )
        label = materialise(label, f"{name}-round")
        if label.where("root <> old").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")

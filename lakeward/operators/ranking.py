"""Exact ``row_number`` that survives hot groups.

A plain window puts a whole partition-by group into one task. When one key can
hold a large share of all rows (e.g. one event id replayed a billion times),
that task is the whole job. Here groups are split in two:

* normal groups go through the ordinary hash-partitioned window;
* hot groups (found by a sample of the scan, see :func:`detect_hot_keys`) are
  globally range-sorted, so a hot group is spread over many tasks, and the
  rank is rebuilt from the sort position plus per-(group, partition) offsets.

Detection only routes rows; both paths are exact, so a missed or a false hot
key costs time, never correctness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.session import ensure_checkpoint_dir


def detect_hot_keys(
    df: DataFrame, keys: list[str], *, task_rows: int = 5_000_000, fraction: float = 0.001, seed: int = 17
) -> DataFrame | None:
    """Keys whose estimated group size exceeds ``task_rows`` rows, NULL keys included.

    A Bernoulli sample of the key columns, aggregated map-side first; take it on a
    scan, not above a shuffle. Every key found is kept, as a small written frame
    (their number is at most rows / ``task_rows`` times two); ``None`` if there
    are none."""
    ensure_checkpoint_dir(df.sparkSession)
    min_hits = max(2, int(task_rows * fraction * 0.5))
    sampled = df.select(*keys).sample(withReplacement=False, fraction=fraction, seed=seed)
    hot = sampled.groupBy(*keys).count().filter(F.col("count") >= min_hits).drop("count").checkpoint(eager=True)
    return None if hot.isEmpty() else hot


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def range_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` for rows of
    hot groups, computed from a global sort instead of one task per group."""
    key_cols = [F.col(k).asc_nulls_first() for k in keys]
    ordered = df.orderBy(*key_cols, *order).withColumn("_mid", F.monotonically_increasing_id())
    # Reliable checkpoint: cuts the lineage so sort positions are fixed even if
    # an executor is lost between the statistics pass and the final pass.
    ensure_checkpoint_dir(df.sparkSession)
    ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumn("_pid", F.shiftright("_mid", 33))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = (
        ordered.groupBy(*keys, "_pid")
        .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .drop("_n")
    )
    s = stats.alias("s")
    o = ordered.alias("o")
    on = _null_safe_on(o, s, keys) & (o["_pid"] == s["_pid"])
    joined = o.join(s, on, "inner").select(
        "o.*", (F.col("o._mid") - F.col("s._first") + F.col("s._before") + 1).alias(out)
    )
    return joined.drop("_mid", "_pid")


def split_hot(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(normal rows, hot rows) by null-safe anti / semi joins with the hot keys.
    No hint: Spark broadcasts the written key list if its real size allows."""
    if hot is None:
        return df, None
    on = _null_safe_on(df, hot, keys)
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")

"""Bucketed incident sessions against session_window, and reachability counts against plain search."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakeward.operators import alerts, lineage


def session_rows(points, threshold, gap):
    """The same incidents by Spark's session windows."""
    return (
        points.filter(F.col("value") > threshold)
        .groupBy("series", F.session_window("ts", f"{gap} seconds").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
        .select("series", "s.start", "s.end", "n", "peak")
    )


@pytest.mark.parametrize("gap", [7, 60, 1800])
def test_bucketed_incidents_are_the_sessions(spark, gap):
    rng, rows, t = random.Random(gap), [], dt.datetime(1969, 12, 31, 23, 0)
    for k in range(600):  # steps around the gap, some of exactly one gap or a microsecond beside it
        t += dt.timedelta(seconds=rng.choice([0, 1, gap / 3, gap - 1e-6, gap, gap + 1e-6, 2.5 * gap]))
        rows.append((f"s{k % 2}" if k % 5 else None, t, rng.choice([1.0, 50.0, 61.0, 99.0])))
    points = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double").repartition(4)
    got = {tuple(r) for r in alerts.incidents(points, 60.0, gap).select("series", "opened_at", "closed_at", "breach_points", "peak_value").collect()}
    assert got == {tuple(r) for r in session_rows(points, 60.0, gap).collect()} and len(got) > 20


def test_no_raw_row_crosses_an_exchange(spark):
    points = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 99.0)], "series string, ts timestamp_ntz, value double")
    plan = alerts.incidents(points, 60.0)._jdf.queryExecution().sparkPlan().toString()
    assert "Session" not in plan and plan.count("partial_min") >= 1
    below = alerts.breach_buckets(points, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert below.index("partial_count") > below.index("Exchange")  # summed up before the exchange


def plain_counts(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    counts = {}
    for a in out:
        seen, stack = set(), list(out[a])
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += out.get(n, ())
        counts[a] = len(seen)
    return counts


def counted(spark, edges):
    return {r.src: r.reachable for r in lineage.reachable_counts(spark.createDataFrame(edges, "src string, dst string")).collect()}


@pytest.mark.parametrize(
    "edges",
    [
        [("r", f"n{i}") for i in range(4)] + [(f"n{i}", f"c{i}{j}") for i in range(3) for j in range(i)] + [("c21", "o")] * 2,  # a tree
        [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("e", "g"), ("c", "x"), ("x", "y")],  # a diamond over a tree
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("z", "a"), ("s", "s"), ("s", "t")],  # cycles
        [("only", "one")],
    ],
)
def test_counts_of_small_graphs(spark, edges):
    assert counted(spark, edges) == plain_counts(edges)


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(f"{rng.randrange(n)}", f"{rng.randrange(n)}") for _ in range(rng.choice([15, 30, 45, 60]))]
    edges += [(f"{i}", f"t{i}-{j}") for i in range(n) for j in range(rng.randrange(3))]
    assert counted(spark, edges) == plain_counts(edges)


def test_a_chain_is_counted_with_a_row_a_round(spark, monkeypatch):
    """A chain has n (n + 1) / 2 pairs; no round may write more than the frontier and what waits."""
    n, written = 200, []
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(n)], "src string, dst string").coalesce(1)
    whole = type(edges).checkpoint

    def counting(self, *a, **k):
        out = whole(self, *a, **k)
        written.append(out.count())
        return out

    monkeypatch.setattr(type(edges), "checkpoint", counting)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.src: r.reachable for r in lineage.reachable_counts(edges).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == {f"{i}": n - i for i in range(n)}
    assert sum(written) <= 4 * n + 10 and max(written[3:]) <= 1

"""Metric alignment, threshold alerts and incident sessions over metric points.

A metric point is (series, ts, value). Alignment is a tumbling event-time
window aggregate; incidents are session windows over breach points (a breach
opens an incident that closes ``gap`` after the last breach).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_points_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Driver events -> gauge points: one series per event type; ``keep`` columns come along."""
    return events.select(
        *keep,
        F.col("event_type").alias("series"),
        F.col("ts").alias("ts"),
        F.col("value").alias("value"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("tier"), (F.col("user_id") % 4).cast("string")).alias(
            "labels"
        ),
    )


def align_max(points: DataFrame, seconds: int = 600) -> DataFrame:
    """Per series, max of each tumbling ``seconds`` window (epoch-aligned)."""
    return (
        points.groupBy("series", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.max("value").alias("max_value"))
        .select("series", F.col("w.start").alias("window_start"), "max_value")
    )


def fraction_true(points: DataFrame, threshold: float, seconds: int = 300) -> DataFrame:
    """Per series and window: fraction of points whose value exceeds threshold."""
    return (
        points.groupBy("series", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.avg((F.col("value") > threshold).cast("double")).alias("fraction_true"))
        .select("series", F.col("w.start").alias("window_start"), "fraction_true")
    )


def threshold_breaches(aligned: DataFrame, threshold: float) -> DataFrame:
    """Aligned windows above the threshold (0 s duration: any window fires)."""
    return aligned.filter(F.col("max_value") > threshold)


def sustained_below(fractions: DataFrame, threshold: float = 0.5, windows: int = 3, seconds: int = 300) -> DataFrame:
    """Windows ending a run of ``windows`` consecutive windows all below
    ``threshold`` (e.g. 3 x 300 s = sustained 900 s). Consecutive means the
    window starts are exactly ``seconds`` apart."""
    w = Window.partitionBy("series").orderBy("window_start").rowsBetween(-(windows - 1), 0)
    return (
        fractions.withColumn("max_in_run", F.max("fraction_true").over(w))
        .withColumn("first_start", F.min("window_start").over(w))
        .withColumn("n", F.count(F.lit(1)).over(w))
        .filter(
            (F.col("n") == windows)
            & (F.col("max_in_run") < threshold)
            & (F.timestamp_diff("SECOND", F.col("first_start"), F.col("window_start")) == (windows - 1) * seconds)
        )
        .select("series", "window_start", "max_in_run")
    )


def breach_buckets(points: DataFrame, threshold: float, gap_seconds: int = 1800) -> DataFrame:
    """Per series and bucket of the gap's width: first and last breach, their number and peak. Points of one bucket are
    less than the gap apart, so they share an incident whatever lies around them; a row per task and bucket is shuffled."""
    return (
        points.filter(F.col("value") > threshold)
        .groupBy("series", F.window("ts", f"{gap_seconds} seconds").alias("w"))
        .agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("breach_points"), F.max("value").alias("peak_value"))
        .select("series", F.col("w.start").alias("bucket"), "first_at", "last_at", "breach_points", "peak_value")
    )


def incidents(points: DataFrame, threshold: float, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of breach points per series: open on a breach, close ``gap_seconds`` after the last one.

    Two levels: raw points meet in buckets, and only the buckets of a series are put in order. A bucket opens a new
    incident if its first breach is more than a gap after the last breach of the bucket before it. So a series of any
    number of points is at most one row per gap of time in one task."""
    order = Window.partitionBy("series").orderBy("bucket")
    gap = F.make_dt_interval(secs=F.lit(gap_seconds).cast("decimal(18,6)"))
    before = F.lag("last_at").over(order)
    opens = before.isNull() | (F.col("first_at") - before > gap)
    numbered = breach_buckets(points, threshold, gap_seconds).withColumn("_opens", opens.cast("int"))
    numbered = numbered.withColumn("_incident", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("series", "_incident")
        .agg(F.min("first_at").alias("opened_at"), (F.max("last_at") + gap).alias("closed_at"), F.sum("breach_points").alias("breach_points"), F.max("peak_value").alias("peak_value"))
        .drop("_incident")
    )


# Labels that would give a series per run, batch, deployment or message.
FORBIDDEN_LABELS = [
    "pipeline_run_id",
    "batch_id",
    "deployment_id",
    "error_message",
    "airflow_run_id",
]


def label_cardinality(points: DataFrame, budget: int = 120) -> DataFrame:
    """Distinct label sets per series and, as the row of no series, over all of them, against the budget for all; and the
    forbidden labels in use."""
    key = F.to_json(F.array_sort(F.map_entries("labels")))
    sets = points.select("series", key.alias("key"), F.map_keys("labels").alias("names")).groupBy("series", "key").agg(F.first("names").alias("names"))
    bad = F.array_sort(F.array_intersect(F.array_distinct(F.flatten(F.collect_set("names"))), F.array(*[F.lit(x) for x in FORBIDDEN_LABELS])))
    each = sets.groupBy("series").agg(F.count(F.lit(1)).alias("label_sets"), F.array_join(bad, ",").alias("forbidden_labels"))
    whole = sets.agg(F.count(F.lit(1)).alias("label_sets"), F.array_join(bad, ",").alias("forbidden_labels")).withColumn("series", F.lit(None).cast("string"))
    return (
        each.unionByName(whole)
        .withColumn("budget", F.lit(budget))
        .withColumn("within_budget", (F.col("label_sets") <= F.col("budget")) & (F.col("forbidden_labels") == ""))
    )


def metric_contract(points: DataFrame, catalog: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Violations of a descriptor catalog {series: {label: allowed values}}: unknown series, extra label, missing label,
    value outside the set. One pass over the points: each carries its own violations, nothing is joined or shuffled."""
    labels, known = F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>")), list(catalog)

    def violation(kind: str, label) -> Column:
        return F.struct((label if isinstance(label, Column) else F.lit(label).cast("string")).alias("label"), F.lit(kind).alias("violation"))

    none = F.array().cast("array<struct<label:string,violation:string>>")
    found = F.when(F.col("series").isNull() | ~F.col("series").isin(known), F.array(violation("unknown_metric_type", None)))
    for series, declared in catalog.items():
        names = list(declared)
        extra = F.array_except(F.map_keys(labels), F.array(*[F.lit(n) for n in names])) if names else F.map_keys(labels)
        own = F.transform(extra, lambda k: violation("unexpected_label", k))
        each = []
        for name, values in declared.items():
            given = F.map_contains_key(labels, F.lit(name))
            inside = F.coalesce(labels[name].isin(values), F.lit(False))
            each.append(F.when(~given, violation("missing_label", name)).when(~inside, violation("value_outside_set", name)))
        checked = F.array_compact(F.array(*each)) if each else none
        found = F.when(F.col("series") == series, F.concat(own, checked)).otherwise(found)
    return points.select("series", "ts", F.explode(F.coalesce(found, none)).alias("v")).select("series", "ts", "v.label", "v.violation")

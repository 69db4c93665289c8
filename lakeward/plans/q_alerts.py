"""Registered queries: metric alignment, alerts, incidents, label budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.operators import alerts
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table

BREACH = 60.0
# Descriptor catalog for the event gauges (tier 3 is deliberately not allowed).
CATALOG = {
    "signup": {"event_type": ["signup"], "tier": ["0", "1", "2"]},
    "purchase": {"event_type": ["purchase"], "tier": ["0", "1", "2"]},
    "view": {"event_type": ["view"], "tier": ["0", "1", "2"]},
    "click": {"event_type": ["click"], "tier": ["0", "1", "2"]},
}


def points(spark, d):
    return alerts.metric_points_from_events(read_table(spark, d, "events"))


TB = "time_bucket(INTERVAL {s} SECOND, ts, TIMESTAMP '1970-01-01')"


@query(
    "metric_align_max",
    f"SELECT event_type AS series, {TB.format(s=600)} AS window_start, max(value) AS max_value FROM events GROUP BY 1, 2",
)
def q_align(spark, d):
    return alerts.align_max(points(spark, d), 600)


@query(
    "metric_fraction_true",
    f"""SELECT event_type AS series, {TB.format(s=300)} AS window_start, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END)
          AS fraction_true FROM events GROUP BY 1, 2""",
)
def q_fraction(spark, d):
    return alerts.fraction_true(points(spark, d), BREACH, 300)


@query(
    "alert_breaches",
    f"""SELECT * FROM (SELECT event_type AS series, {TB.format(s=600)} AS window_start, max(value) AS max_value
          FROM events GROUP BY 1, 2) WHERE max_value > 60""",
)
def q_breaches(spark, d):
    return alerts.threshold_breaches(alerts.align_max(points(spark, d), 600), BREACH)


@query(
    "alert_sustained",
    f"""WITH f AS (SELECT event_type AS series, {TB.format(s=300)} AS window_start,
                     avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) AS fraction_true FROM events GROUP BY 1, 2),
        r AS (SELECT *, max(fraction_true) OVER w AS max_in_run, min(window_start) OVER w AS first_start,
                     count(*) OVER w AS n FROM f
              WINDOW w AS (PARTITION BY series ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
        SELECT series, window_start, max_in_run FROM r
        WHERE n = 3 AND max_in_run < 0.5 AND date_sub('second', first_start, window_start) = 600""",
)
def q_sustained(spark, d):
    return alerts.sustained_below(alerts.fraction_true(points(spark, d), BREACH, 300), 0.5, 3, 300)


@query(
    "alert_incidents",
    """WITH b AS (SELECT event_type AS series, ts, value FROM events WHERE value > 60),
        l AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY series ORDER BY ts) IS NULL
                   OR ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS brk
              FROM b),
        g AS (SELECT *, sum(brk) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
        SELECT series, min(ts) AS opened_at, max(ts) + INTERVAL 1800 SECOND AS closed_at, count(*) AS breach_points,
               max(value) AS peak_value FROM g GROUP BY series, sid""",
)
def q_incidents(spark, d):
    return alerts.incidents(points(spark, d), BREACH, 1800)


@query(
    "metric_cardinality",
    """WITH p AS (SELECT event_type AS series, user_id % 4 AS tier, CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN event_id % 7 END AS batch FROM events),
       sets AS (SELECT DISTINCT series, tier, batch FROM p),
       counted AS (SELECT series, count(*) AS label_sets, bool_or(batch IS NOT NULL) AS bad FROM sets GROUP BY series
                   UNION ALL SELECT NULL, count(*), bool_or(batch IS NOT NULL) FROM sets)
       SELECT series, label_sets, if(bad, 'batch_id', '') AS forbidden_labels, 30 AS budget, label_sets <= 30 AND NOT bad AS within_budget FROM counted""",
)
def q_cardinality(spark, d):
    """Label sets against a budget of 30; some points of one series carry their batch as a label, which none may."""
    named = alerts.metric_points_from_events(read_table(spark, d, "events"), keep=("event_id",))
    batch = F.create_map(F.lit("batch_id"), (F.col("event_id") % 7).cast("string"))
    labels = F.when((F.col("series") == "view") & (F.col("event_id") % 50 == 0), F.map_concat("labels", batch)).otherwise(F.col("labels"))
    return alerts.label_cardinality(named.withColumn("labels", labels), 30)


@query(
    "metric_contract",
    """WITH p AS (SELECT *, if(event_id % 29 = 1, 'legacy', event_type) AS series FROM events)
       SELECT series, ts, NULL::VARCHAR AS label, 'unknown_metric_type' AS violation FROM p
         WHERE series NOT IN ('signup', 'purchase', 'view', 'click')
       UNION ALL SELECT series, ts, 'zone', 'unexpected_label' FROM p
         WHERE series IN ('signup', 'purchase', 'view', 'click') AND user_id % 17 = 3
       UNION ALL SELECT series, ts, 'tier', if(user_id % 13 = 5, 'missing_label', 'value_outside_set') FROM p
         WHERE series IN ('signup', 'purchase', 'view', 'click') AND (user_id % 13 = 5 OR user_id % 4 = 3)""",
)
def q_contract(spark, d):
    """Event gauges against the catalog; some come under an unknown name, without their tier, or with a label too many."""
    events = read_table(spark, d, "events")
    e, u = F.col("event_id"), F.col("user_id")
    named = alerts.metric_points_from_events(events.withColumn("event_type", F.when(e % 29 == 1, "legacy").otherwise(F.col("event_type"))), keep=("user_id",))
    labels = F.map_filter("labels", lambda k, _: ~((k == "tier") & (u % 13 == 5)))
    labels = F.when(u % 17 == 3, F.map_concat(labels, F.create_map(F.lit("zone"), F.lit("z")))).otherwise(labels)
    return alerts.metric_contract(named.withColumn("labels", labels), CATALOG)

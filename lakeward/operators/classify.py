"""Row classification: dedup ranks, country validity, one rejection reason.

Shuffle plan: both windows (within-batch by (batch_scope, event_id) and
canonical by event_id) are clustered by ``event_id``; one hash exchange on
``event_id`` satisfies both, so the classification costs a single shuffle of
the staged rows plus a broadcast of the bounded country seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.operators.ranking import detect_hot_keys, range_row_number, split_hot
from lakeward.schemas import ACCEPTED, PUBLISHED_CLASSIFICATION_COLUMNS, SEED_COUNTRY_CODES

WITHIN_KEYS = ["batch_scope", "event_id"]
CANONICAL_KEYS = ["event_id"]


def within_order():
    """Latest write wins within a batch."""
    return [
        F.col("ingested_at").desc(),
        F.col("event_timestamp").desc(),
        F.col("source_file").desc(),
        F.col("raw_record_hash").desc(),
    ]


def canonical_order():
    """Within-batch winners first, then first-seen batch wins."""
    return [
        F.col("within_batch_duplicate_rank").asc(),
        F.col("ingested_at").asc(),
        F.col("event_timestamp").desc(),
        F.col("source_file").desc(),
        F.col("raw_record_hash").desc(),
    ]

def country_seed(spark: SparkSession) -> DataFrame:
    """The valid-country seed (10 rows, all active)."""
    # inline values, not createDataFrame: Spark then knows their size and broadcasts them on its own
    codes = ", ".join(f"('{c}', true)" for c in SEED_COUNTRY_CODES)
    return spark.sql(f"SELECT * FROM VALUES {codes} AS t(country_code, is_active)")


def _window_ranks(df: DataFrame) -> DataFrame:
    # hash(event_id) satisfies both windows' clustering: one exchange in total.
    w1 = Window.partitionBy(*WITHIN_KEYS).orderBy(*within_order())
    w2 = Window.partitionBy(*CANONICAL_KEYS).orderBy(*canonical_order())
    return (
        df.repartition("event_id")
        .withColumn("within_batch_duplicate_rank", F.row_number().over(w1))
        .withColumn("duplicate_rank", F.row_number().over(w2))
    )


def _range_ranks(df: DataFrame) -> DataFrame:
    df = range_row_number(df, WITHIN_KEYS, within_order(), "within_batch_duplicate_rank")
    return range_row_number(df, CANONICAL_KEYS, canonical_order(), "duplicate_rank")


def rank_duplicates(stg: DataFrame, hot_event_ids: DataFrame | None | str = "auto") -> DataFrame:
    """Adds ``batch_scope``, ``within_batch_duplicate_rank`` and ``duplicate_rank``.

    ``hot_event_ids``: "auto" samples the input for event ids too big for one
    task; a DataFrame of known hot ids; or None to skip the skew path. ``stg``
    must not be shuffled yet: hot rows part from the others before any exchange
    and go straight to the range sort."""
    scoped = stg.withColumn("batch_scope", F.coalesce("batch_id", "pipeline_run_id"))
    if isinstance(hot_event_ids, str):
        hot_event_ids = detect_hot_keys(scoped, CANONICAL_KEYS)
    normal, hot = split_hot(scoped, hot_event_ids, CANONICAL_KEYS)
    ranked = _window_ranks(normal)
    if hot is not None:
        ranked = ranked.unionByName(_range_ranks(hot))
    return ranked


def classify_events(
    stg: DataFrame,
    countries: DataFrame | None = None,
    *,
    now=None,
    hot_event_ids: DataFrame | None | str = "auto",
) -> DataFrame:
    """``stg_events`` -> ``int_event_classification`` (one row per physical row).

    Precedence: missing_user_id > invalid_country_code > future_dated >
    duplicate_extra > accepted. Ranks are computed over every staged row, before
    reasons are assigned (a rejected rank-1 row still outranks its siblings)."""
    spark = stg.sparkSession
    if countries is None:
        countries = country_seed(spark)
    # One row per code by the seed's grain, so the left join stays 1:1.
    active = countries.filter(F.col("is_active")).select("country_code").withColumn("_valid_country", F.lit(True))
    ranked = rank_duplicates(stg, hot_event_ids)
    joined = ranked.join(active, "country_code", "left")
    is_valid = F.col("_valid_country").isNotNull()
    within_dup = F.col("within_batch_duplicate_rank") > 1
    extra = F.col("duplicate_rank") > 1
    reason = (
        F.when(F.col("user_id").isNull(), "missing_user_id")
        .when(~is_valid, "invalid_country_code")
        .when(F.col("is_future_dated"), "future_dated")
        .when(extra, "duplicate_extra")
        .otherwise(ACCEPTED)
    )
    out = joined.select(
        *[c for c in stg.columns],
        "within_batch_duplicate_rank",
        within_dup.alias("is_within_batch_duplicate"),
        "duplicate_rank",
        extra.alias("is_duplicate_extra"),
        is_valid.alias("is_valid_country"),
        F.when(within_dup, "within_batch").when(extra, "cross_batch_replay").otherwise("none").alias("duplicate_scope"),
        reason.alias("rejection_reason"),
    )
    return out.withColumn("is_accepted", F.col("rejection_reason") == ACCEPTED).withColumn(
        "classified_at", now if now is not None else F.current_timestamp()
    )


def accepted_events(classified: DataFrame) -> DataFrame:
    """One row per accepted event id (a lazy view over the classification)."""
    return classified.filter(F.col("rejection_reason") == ACCEPTED).select(
        *PUBLISHED_CLASSIFICATION_COLUMNS, "classified_at"
    )


def rejected_events(classified: DataFrame, *, now=None) -> DataFrame:
    """Quarantine: one row per rejected physical row."""
    return (
        classified.filter(F.col("rejection_reason") != ACCEPTED)
        .select(*PUBLISHED_CLASSIFICATION_COLUMNS, "classified_at")
        .withColumn("quarantined_at", now if now is not None else F.current_timestamp())
    )


def duplicate_scope_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("rejection_reason", "duplicate_scope").agg(F.count(F.lit(1)).alias("row_count"))

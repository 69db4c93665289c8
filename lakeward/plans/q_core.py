"""Registered queries: landing, staging, classification, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.operators import publish, staging
from lakeward.operators.classify import duplicate_scope_counts
from lakeward.plans.oracle import FACT_COLS, PUBLISHED, with_core
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.registry import query

STG_COLS = """event_id, user_id, event_name, event_timestamp, event_date, country_code, platform, app_version,
  ingested_at, source_file, pipeline_run_id, batch_id, processing_date, raw_record_hash, event_timestamp_date,
  ingested_date, is_future_dated, is_event_time_late_arriving, is_backdated_event_date,
  has_event_date_timestamp_mismatch"""


@query("raw_enriched", with_core("SELECT * FROM raw"))
def q_raw_enriched(spark, sf_dir):
    return Pipeline(spark, sf_dir).raw


@query("stg_events", with_core("SELECT * FROM stg"))
def q_stg_events(spark, sf_dir):
    return Pipeline(spark, sf_dir).stg


@query(
    "record_hash",
    with_core(
        "SELECT event_id, source_file, raw_record_hash FROM stg"
    ),
)
def q_record_hash(spark, sf_dir):
    return Pipeline(spark, sf_dir).stg.select("event_id", "source_file", "raw_record_hash")


@query(
    "temporal_flags",
    with_core(
        """SELECT event_date, coalesce(batch_id, pipeline_run_id) AS batch_scope,
             count(*) AS row_count,
             count_if(is_future_dated) AS future_dated_count,
             count_if(is_event_time_late_arriving) AS event_time_late_count,
             count_if(is_backdated_event_date) AS backdated_event_date_count,
             count_if(has_event_date_timestamp_mismatch) AS date_timestamp_mismatch_count
           FROM stg GROUP BY 1, 2"""
    ),
)
def q_temporal_flags(spark, sf_dir):
    return staging.temporal_flags(Pipeline(spark, sf_dir).stg)


_CLS_COLS = f"""{STG_COLS}, within_batch_duplicate_rank, is_within_batch_duplicate, duplicate_rank,
  is_duplicate_extra, is_valid_country, duplicate_scope, rejection_reason, is_accepted"""


@query("classify_events", with_core(f"SELECT {_CLS_COLS} FROM classified"))
def q_classify_events(spark, sf_dir):
    return Pipeline(spark, sf_dir).classified.drop("classified_at")


@query(
    "within_batch_rank",
    with_core(
        """SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, event_id, source_file, ingested_at,
             within_batch_duplicate_rank FROM classified"""
    ),
)
def q_within_batch_rank(spark, sf_dir):
    return Pipeline(spark, sf_dir).classified.select(
        F.coalesce("batch_id", "pipeline_run_id").alias("batch_scope"),
        "event_id",
        "source_file",
        "ingested_at",
        "within_batch_duplicate_rank",
    )


@query(
    "canonical_rank",
    with_core("SELECT event_id, source_file, ingested_at, duplicate_rank, is_duplicate_extra FROM classified"),
)
def q_canonical_rank(spark, sf_dir):
    return Pipeline(spark, sf_dir).classified.select(
        "event_id", "source_file", "ingested_at", "duplicate_rank", "is_duplicate_extra"
    )


@query(
    "duplicate_scope_counts",
    with_core(
        "SELECT rejection_reason, duplicate_scope, count(*) AS row_count FROM classified GROUP BY 1, 2"
    ),
)
def q_duplicate_scope_counts(spark, sf_dir):
    return duplicate_scope_counts(Pipeline(spark, sf_dir).classified)


@query("accepted_events", with_core("SELECT * FROM accepted"))
def q_accepted(spark, sf_dir):
    return Pipeline(spark, sf_dir).accepted.drop("classified_at")


@query("rejected_events", with_core("SELECT * FROM rejected"))
def q_rejected(spark, sf_dir):
    return Pipeline(spark, sf_dir).rejected.drop("classified_at", "quarantined_at")


@query(
    "dim_users",
    with_core(
        """SELECT user_id, min(event_timestamp) AS first_event_at, max(event_timestamp) AS last_event_at,
             count(*) AS event_count FROM accepted WHERE user_id IS NOT NULL GROUP BY user_id"""
    ),
)
def q_dim_users(spark, sf_dir):
    return Pipeline(spark, sf_dir).dim_users.drop("updated_at")


@query("fct_events", with_core(f"SELECT {FACT_COLS} FROM fact"))
def q_fct_events(spark, sf_dir):
    return Pipeline(spark, sf_dir).fact.drop("loaded_to_core_at", "updated_at")


MART_SQL = """SELECT event_date, event_name, country_code, platform, count(*) AS event_count,
      count(DISTINCT user_id) AS distinct_user_count,
      count_if(is_backdated_event_date) AS backdated_event_date_count,
      count_if(has_event_date_timestamp_mismatch) AS event_date_timestamp_mismatch_count,
      count_if(is_event_time_late_arriving) AS event_time_late_arriving_count
    FROM fact GROUP BY 1, 2, 3, 4"""


@query("daily_event_mart", with_core(MART_SQL))
def q_daily_event_mart(spark, sf_dir):
    return Pipeline(spark, sf_dir).mart.drop("updated_at")

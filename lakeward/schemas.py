"""Table schemas and fixed values of the data platform."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Seed of valid country codes (all active), in file order.
SEED_COUNTRY_CODES = ["US", "CA", "GB", "AU", "DE", "FR", "BR", "MX", "IN", "JP"]
# Rejection reasons in precedence order, then the accepted label.
REJECTION_REASONS = [
    "missing_user_id",
    "invalid_country_code",
    "future_dated",
    "duplicate_extra",
]
ACCEPTED = "accepted"
DUPLICATE_SCOPES = ["within_batch", "cross_batch_replay", "none"]
# Exact anomaly counts a standard 50,000-row batch carries.
ANOMALY_PROFILE = {
    "duplicate_pairs": 50,
    "null_user_ids": 500,
    "invalid_country_codes": 200,
    "future_timestamps": 150,
    "late_arriving_events": 300,
}
STANDARD_BATCH_ROWS = 50000
# Fact incremental lookback (days).
LOOKBACK_DAYS = 3

# ---------------------------------------------------------------------------
# Fixed values too: the tables' columns and types, in the order of their declarations.
# ---------------------------------------------------------------------------
EVENT_LINE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("app_version", T.StringType()),
    ]
)
REQUIRED_EVENT_FIELDS = ["event_id", "event_name", "event_timestamp", "event_date"]

LOAD_METADATA = T.StructType(
    [
        T.StructField("ingested_at", T.TimestampNTZType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("pipeline_run_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("processing_date", T.DateType()),
    ]
)
RAW_EVENTS = T.StructType(EVENT_LINE.fields + LOAD_METADATA.fields)
RAW_COLUMNS = [f.name for f in RAW_EVENTS.fields]

# Projection shared by the accepted view and the quarantine table.
PUBLISHED_CLASSIFICATION_COLUMNS = [
    "event_id",
    "user_id",
    "event_name",
    "event_timestamp",
    "event_date",
    "country_code",
    "platform",
    "app_version",
    "ingested_at",
    "source_file",
    "pipeline_run_id",
    "batch_id",
    "raw_record_hash",
    "duplicate_rank",
    "is_duplicate_extra",
    "is_valid_country",
    "is_future_dated",
    "is_event_time_late_arriving",
    "is_backdated_event_date",
    "has_event_date_timestamp_mismatch",
    "rejection_reason",
]

FACT_COLUMNS = [
    "event_id",
    "user_id",
    "event_name",
    "event_timestamp",
    "event_date",
    "country_code",
    "platform",
    "app_version",
    "ingested_at",
    "source_file",
    "pipeline_run_id",
    "batch_id",
    "raw_record_hash",
    "is_backdated_event_date",
    "has_event_date_timestamp_mismatch",
    "is_event_time_late_arriving",
]

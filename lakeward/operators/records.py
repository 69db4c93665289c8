"""Contracts of JSON records and audit rows: event versions, log lines, vocabularies,
run summaries, persisted check results, rollback decisions, snapshots and ids.

JSON is read as ``variant`` on the JVM; each row carries its own verdict, so valid
and rejected rows come out of one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lakeward.operators.text import redact

# Fields of each event version, the log contract's fields, vocabularies, check categories.
EVENT_FIELDS_V1 = [
    "event_id",
    "event_type",
    "event_timestamp",
    "user_id",
    "country_code",
    "device_type",
    "session_id",
    "payload_size_bytes",
    "batch_id",
    "processing_date",
]
EVENT_FIELDS_V2_ONLY = [
    "schema_version",
    "client_app_version",
]
EVENT_FIELDS = {1: EVENT_FIELDS_V1, 2: EVENT_FIELDS_V1 + EVENT_FIELDS_V2_ONLY}
CORRELATION_FIELDS = [
    "deployment_id",
    "airflow_run_id",
    "pipeline_run_id",
    "batch_id",
    "task_id",
    "attempt_number",
]
LOG_FIELDS = [
    "timestamp",
    "severity",
    "event_type",
    "component",
    "environment",
    "git_sha",
    "dag_id",
    "processing_date",
    "status",
    "duration_ms",
    "rows_generated",
    "rows_loaded",
    "rows_accepted",
    "rows_rejected",
    "fact_rows",
    "mart_event_count",
    "check_name",
    "check_category",
    "observed_value",
    "threshold",
    "expected_value",
    "error_type",
    "error_message",
    "correlation_id",
    "message",
    "details",
    *CORRELATION_FIELDS,
]
LOG_INT_FIELDS = [
    "attempt_number",
    "duration_ms",
    "rows_generated",
    "rows_loaded",
    "rows_accepted",
    "rows_rejected",
    "fact_rows",
    "mart_event_count",
]
SEVERITIES = [
    "DEBUG",
    "INFO",
    "WARNING",
    "ERROR",
    "CRITICAL",
]
RUN_STATUSES = [
    "RUNNING",
    "SUCCESS",
    "FAILED",
    "PARTIAL",
]
TASK_EVENT_TYPES = [
    "STARTED",
    "RETRY",
    "SUCCESS",
    "FAILED",
    "SKIPPED",
    "UPSTREAM_FAILED",
]
DEPLOYMENT_STATUSES = [
    "RUNNING",
    "SUCCESS",
    "FAILED",
    "ROLLING_BACK",
    "ROLLED_BACK",
    "ROLLBACK_FAILED",
]
DEPLOYMENT_TYPES = [
    "deploy",
    "rollback",
]
RECOVERY_ACTIONS = [
    "RETRY_TASK",
    "RERUN_BATCH",
    "REPAIR_PARTIAL_LOAD",
    "QUARANTINE_BATCH",
    "BACKFILL",
    "RESTORE_RELEASE",
    "FORWARD_MIGRATION",
    "RESTORE_IAM",
    "REBUILD_PARTITION",
    "PAUSE_SCHEDULE",
    "RESUME_SCHEDULE",
    "RECONSTRUCT_AUDIT",
    "RESET_MONITOR",
    "MANUAL_CONTAINMENT",
]
RECOVERY_STATUSES = [
    "RUNNING",
    "SUCCESS",
    "FAILED",
    "PARTIAL",
    "ABORTED",
]
VERIFICATION_STATUSES = [
    "PENDING",
    "VERIFIED",
    "FAILED",
    "SKIPPED",
]
CATEGORIES = [
    "FRESHNESS",
    "COMPLETENESS",
    "UNIQUENESS",
    "REFERENTIAL_INTEGRITY",
    "SCHEMA",
    "VOLUME",
    "REJECTION_RATE",
    "RECONCILIATION",
]
QUALITY_STATUSES = [
    "PASS",
    "WARN",
    "FAIL",
    "NO_DATA",
]
EVALUATION_STATUSES = [
    "PASS",
    "WARN",
    "FAIL",
    "NO_DATA",
    "DISABLED",
]
QUALITY_SEVERITIES = [
    "INFO",
    "WARNING",
    "CRITICAL",
]
COST_COMPONENTS = [
    "pipeline",
    "monitor",
    "deployment",
    "validation",
    "audit",
    "migration",
    "ingestion",
    "adhoc",
]
CHECK_CATEGORIES = {
    "batch_nonempty": "COMPLETENESS",
    "raw_equals_classification": "RECONCILIATION",
    "accepted_plus_rejected_equals_raw": "RECONCILIATION",
    "accepted_equals_fact": "RECONCILIATION",
    "fact_event_ids_unique": "UNIQUENESS",
    "fact_user_fk_resolves": "REFERENTIAL_INTEGRITY",
    "fact_country_fk_resolves": "REFERENTIAL_INTEGRITY",
    "mart_totals_reconcile": "RECONCILIATION",
    "processing_date_semantics": "COMPLETENESS",
    "batch_lineage_semantics": "COMPLETENESS",
}
DEFAULT_CATEGORY = "RECONCILIATION"
DETAILS_LENGTH = 4000
BATCH_ID = r"\A[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}\z"


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _whole(v: Column, name: str) -> Column:
    """A JSON value as a whole number: fractions of numbers are cut, booleans are 0 or 1, texts must be integers."""
    value = F.try_variant_get(v, f"$.{name}", "variant")
    kind, text = F.schema_of_variant(value), F.trim(_field(v, name))
    return (
        F.when(kind == "STRING", F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint")))
        .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
        .otherwise(text.try_cast("decimal(38,9)").try_cast("bigint"))
    )


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def normalize_event_versions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every line on the current shape (absent fields NULL) with ``schema_version`` and ``reason``.

    No discriminator means version 1. A line that is no JSON object, whose version
    is no integer or not supported, or that has a field its version does not know,
    is rejected: ``reason`` says why, ``unknown_fields`` which.
    """
    v = F.try_parse_json(F.col(line))
    parsed = lines.withColumn("_v", v).withColumn("_keys", F.json_object_keys(F.when(v.isNotNull(), F.col(line))))
    declared = F.array_contains("_keys", "schema_version")
    parsed = parsed.withColumn("_version", F.when(declared, _whole(F.col("_v"), "schema_version")).otherwise(F.lit(1)))
    unknown = F.lit(None).cast("array<string>")
    for version, fields in EVENT_FIELDS.items():
        unknown = F.when(F.col("_version") == version, F.array_sort(F.array_except("_keys", _strings(fields)))).otherwise(unknown)
    parsed = parsed.withColumn("_unknown", unknown)
    reason = (
        F.when(F.col("_keys").isNull(), "not_an_object")
        .when(F.col("_version").isNull(), "version_not_an_integer")
        .when(~F.col("_version").isin(*EVENT_FIELDS), "version_unsupported")
        .when(F.size("_unknown") > 0, "unknown_fields")
    )
    current = sorted(f for f in EVENT_FIELDS[max(EVENT_FIELDS)] if f != "schema_version")
    kept = [F.col(f"`{c}`") for c in lines.columns]
    return parsed.withColumn("reason", reason).select(
        *kept,
        *[F.when(F.col("reason").isNull(), _field(F.col("_v"), f)).alias(f) for f in current],
        F.when(F.col("reason").isNull(), F.col("_version")).cast("int").alias("schema_version"),
        "reason",
        F.when(F.col("reason") == "unknown_fields", F.array_join("_unknown", ",")).alias("unknown_fields"),
    )


def log_contract(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines on the contract: unknown fields and values of the wrong type go, and are named in ``contract_violations``.

    An unknown severity becomes INFO, error messages are redacted, ``details`` above
    the limit are cut to a preview. Lines without an event type are rejected.
    """
    v = F.try_parse_json(F.col(line))
    parsed = lines.withColumn("_v", v).withColumn("_keys", F.json_object_keys(F.when(v.isNotNull(), F.col(line))))
    v = F.col("_v")
    severity = F.upper(F.coalesce(_field(v, "severity"), F.lit("INFO")))
    values = F.from_json(F.when(v.isNotNull(), F.col(line)), "map<string,string>")
    given = F.filter(  # a field given as null counts as not given
        F.coalesce("_keys", F.array().cast("array<string>")),
        lambda k: ~k.isin("severity", "event_type", "platform_event") & F.try_element_at("_values", k).isNotNull(),
    )
    wrong = [F.when(_field(v, f).isNotNull() & _whole(v, f).isNull(), F.lit(f)) for f in LOG_INT_FIELDS]
    parsed = parsed.withColumns(
        {"_severity": severity, "_values": values, "_wrong": F.array_compact(F.array(*wrong)), "_ok": F.get_json_object(line, "$.event_type") != ""}
    )
    violations = F.concat(
        F.when(F.col("_severity").isin(*SEVERITIES), F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("severity:"), F.col("_severity")))
        ),
        F.transform(F.filter(given, lambda k: ~k.isin(*LOG_FIELDS)), lambda k: F.concat(F.lit("field:"), k)),
        F.transform("_wrong", lambda k: F.concat(F.lit("type:"), k)),
    )
    out = {"severity": F.when(F.col("_severity").isin(*SEVERITIES), F.col("_severity")).otherwise("INFO")}
    for f in LOG_FIELDS:
        if f in out:
            continue
        out[f] = _whole(v, f) if f in LOG_INT_FIELDS else _field(v, f)
    out["error_message"] = redact(out["error_message"])
    details = F.get_json_object(line, "$.details")
    preview = F.to_json(F.struct(F.lit(True).alias("truncated"), F.left(details, F.lit(DETAILS_LENGTH)).alias("preview")))
    out["details"] = F.when(F.length(details) > DETAILS_LENGTH, preview).otherwise(details)
    kept = [F.col(f"`{c}`") for c in lines.columns]
    return parsed.select(
        *kept,
        *[F.when(F.col("_ok"), c).alias(f) for f, c in out.items()],
        F.when(F.col("_ok"), F.array_join(violations, ",")).alias("contract_violations"),
        (~F.coalesce("_ok", F.lit(False))).alias("rejected"),
    )


def log_errors_and_retries(logs: DataFrame) -> DataFrame:
    """Contract log rows at ERROR and above, or about a retry."""
    return logs.where(F.col("severity").isin("ERROR", "CRITICAL") | F.lower("event_type").contains("retry"))


def vocab_violations(rows: DataFrame, ids: list[str], rules: dict[str, Column]) -> DataFrame:
    """``ids, violation``: one row per rule that a row breaks. A rule that is NULL counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*ids, F.explode(broken).alias("violation"))


def run_rules() -> dict[str, Column]:
    return {"status": F.col("status").isin(*RUN_STATUSES)}


def deployment_rules() -> dict[str, Column]:
    return {"status": F.col("status").isin(*DEPLOYMENT_STATUSES), "deployment_type": F.col("deployment_type").isin(*DEPLOYMENT_TYPES)}


def quality_rules() -> dict[str, Column]:
    return {
        "check_category": F.col("check_category").isin(*CATEGORIES),
        "status": F.col("status").isin(*QUALITY_STATUSES),
        "severity": F.col("severity").isin(*QUALITY_SEVERITIES),
    }


def evaluation_rules() -> dict[str, Column]:
    return {"status": F.col("status").isin(*EVALUATION_STATUSES), "severity": F.col("severity").isin(*QUALITY_SEVERITIES)}


def cost_label_rules() -> dict[str, Column]:
    return {"component": F.col("component").isin(*COST_COMPONENTS)}


def task_event_rules() -> dict[str, Column]:
    return {"event_type": F.col("event_type").isin(*TASK_EVENT_TYPES), "attempt": F.col("attempt") >= 1}


def recovery_rules() -> dict[str, Column]:
    verified = F.col("verification_status").eqNullSafe(F.lit("VERIFIED"))
    return {
        "action_type": F.col("action_type").isin(*RECOVERY_ACTIONS),
        "status": F.col("status").isin(*RECOVERY_STATUSES),
        "verification_status": F.col("verification_status").isNull() | F.col("verification_status").isin(*VERIFICATION_STATUSES),
        "success_needs_verified": ~F.col("status").eqNullSafe(F.lit("SUCCESS")) | verified,
    }


def finalizer_reconcile(summaries: DataFrame, audit: DataFrame) -> DataFrame:
    """Run summaries against their audit rows: ``mismatches`` names what differs, or the missing row."""
    a = audit.select(*[F.col(c).alias(f"_a_{c}") for c in ("pipeline_run_id", "batch_id", "status")])
    j = summaries.join(a, F.col("pipeline_run_id") == F.col("_a_pipeline_run_id"), "left")
    missing = F.col("_a_pipeline_run_id").isNull()
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_a_{c}")), F.lit(f"{c} mismatch")) for c in ("batch_id", "status")]
    mismatches = F.when(missing, F.array(F.lit("missing audit row"))).otherwise(F.array_compact(F.array(*differs)))
    return j.select(
        "pipeline_run_id",
        F.array_join(mismatches, ",").alias("mismatches"),
        (F.size(mismatches) == 0).alias("reconciled"),
        F.col("status").alias("local_status"),
        F.col("_a_status").alias("audit_status"),
        F.coalesce(F.col("status").isin("FAILED", "PARTIAL"), F.lit(False)).alias("must_fail"),
    )


def capped_details(details: Column, limit: int = DETAILS_LENGTH) -> Column:
    """JSON text within the limit (ending in ``...`` when cut); an empty object is NULL."""
    cut = F.when(F.length(details) > limit, F.concat(F.left(details, F.lit(limit - 3)), F.lit("..."))).otherwise(details)
    return F.when(details != "{}", cut)


def as_number(rows: DataFrame, name: str) -> Column:
    """A numeric column as double; text is no number, whatever it says, and neither is a truth value."""
    return (F.col(name) if isinstance(rows.schema[name].dataType, NumericType) else F.lit(None)).cast("double")


def quality_results(checks: DataFrame) -> DataFrame:
    """One durable row per check of a suite (``batch_id, check_name, status, expected, actual``); the overall verdict is none."""
    category = F.create_map(*[F.lit(x) for pair in CHECK_CATEGORIES.items() for x in pair])
    details = F.to_json(F.struct(F.col("actual").cast("string").alias("actual"), F.col("expected").cast("string").alias("expected")))
    return checks.where("check_name <> 'overall'").select(
        "batch_id",
        "check_name",
        F.coalesce(F.try_element_at(category, F.col("check_name")), F.lit(DEFAULT_CATEGORY)).alias("check_category"),
        F.when(F.col("status") == "FAIL", "CRITICAL").otherwise("INFO").alias("severity"),
        "status",
        as_number(checks, "actual").alias("observed_value"),
        as_number(checks, "expected").alias("expected_value"),
        capped_details(details).alias("details_json"),
    )


def rollback_eligibility(applied: DataFrame, known: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per release of ``known`` (release, migration_id) whether it may come back onto the ``applied`` schema.

    Applied migrations that a release does not know block it when ``manifest``
    (migration_id, breaking) flags them, or does not list them. What is newer is
    all that is applied less what is known, so releases are never paired with
    migrations.
    """
    m = manifest.groupBy("migration_id").agg(F.max("breaking").alias("breaking"))
    kinds = applied.select("migration_id").distinct().join(m, "migration_id", "left").select(
        "migration_id",
        F.coalesce("breaking", F.lit(False)).cast("int").alias("breaking"),
        F.col("breaking").isNull().cast("int").alias("unlisted"),
    )
    counts = (F.count("migration_id"), F.coalesce(F.sum("breaking"), F.lit(0)), F.coalesce(F.sum("unlisted"), F.lit(0)))
    total = kinds.agg(*[c.alias(n) for c, n in zip(counts, ("t_n", "t_b", "t_u"), strict=True)]).withColumn("_k", F.lit(1))
    own = known.select("release", "migration_id").distinct().join(kinds, "migration_id", "left")
    own = own.groupBy("release").agg(
        F.count("breaking").alias("n"), counts[1].alias("b"), counts[2].alias("u")
    ).withColumn("_k", F.lit(1))
    newer, breaking, unlisted = F.col("t_n") - F.col("n"), F.col("t_b") - F.col("b"), F.col("t_u") - F.col("u")
    return own.join(total, "_k").select(
        "release",
        newer.alias("newer_applied"),
        breaking.alias("breaking"),
        unlisted.alias("unlisted"),
        F.when(breaking > 0, "BLOCKED_BREAKING").when(unlisted > 0, "BLOCKED_UNLISTED").otherwise("ELIGIBLE").alias("decision"),
    )


def snapshot_diff(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: ``copies`` above zero are missing in ``fresh``, below zero new there."""
    both = committed.withColumn("_n", F.lit(1)).unionByName(fresh.withColumn("_n", F.lit(-1)))
    return both.groupBy(*[f"`{c}`" for c in committed.columns]).agg(F.sum("_n").alias("copies")).where("copies <> 0")


def expired_rows(rows: DataFrame, when: str, days: int | None, as_of: str) -> DataFrame:
    """Rows older than ``days`` before ``as_of`` (0 is a real limit); none where ``days`` is None (kept forever)."""
    if days is None:
        return rows.where(F.lit(False))
    return rows.where(F.col(when) < F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp"))


def batch_identity(runs: DataFrame, prefix: str = "batch") -> DataFrame:
    """Ids of a run from ``processing_date``, ``scheduler_run_id`` and an optional ``given_batch_id``."""
    day = F.date_format("processing_date", "yyyyMMdd")
    suffix = F.left(F.regexp_replace(F.regexp_replace("scheduler_run_id", r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit(120))
    seed = F.conv(F.left(F.sha2(F.date_format("processing_date", "yyyy-MM-dd"), 256), F.lit(8)), 16, 10).cast("bigint")
    return runs.select(
        "*",
        F.coalesce("given_batch_id", F.concat(F.lit(f"{prefix}-"), day)).alias("batch_id"),
        F.coalesce(F.col("given_batch_id").rlike(BATCH_ID), F.lit(True)).alias("valid"),
        F.concat(F.lit(f"{prefix}-run-"), day, F.lit("-"), suffix).alias("pipeline_run_id"),
        seed.alias("seed"),
    )

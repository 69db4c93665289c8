"""Data-quality suites as single-pass aggregations.

A suite is a long table ``(scope..., check_name, status, expected, actual)``.
The reference runs one warehouse round trip per check; here every per-scope
count comes out of one grouped aggregation (plus one pre-aggregation by key for
distinct / duplicate counts), for all batches at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.schemas import ANOMALY_PROFILE, SEED_COUNTRY_CODES, STANDARD_BATCH_ROWS

# Fixed values (as are the names of all checks and tests in this module): checks that
# report an injected anomaly: detecting it is FAIL, and the batch
# (orchestrated) mode leaves them out of the overall verdict.
ANOMALY_CHECKS = [
    "duplicates",
    "null_user_ids",
    "invalid_country_codes",
    "future_timestamps",
    "late_arriving_events",
]


def check(name: str, passed: Column, expected: Column | int | None, actual: Column | int | None) -> Column:
    """One suite row as a struct (status from a boolean predicate)."""

    def lit_long(v):
        if isinstance(v, Column):
            return v.cast("bigint")
        if isinstance(v, str):
            return F.col(v).cast("bigint")
        return F.lit(v).cast("bigint")

    return F.struct(
        F.lit(name).alias("check_name"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        lit_long(expected).alias("expected"),
        lit_long(actual).alias("actual"),
    )


def stack_checks(df: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    """Wide one-row-per-scope frame -> long (keys, check_name, status, expected, actual)."""
    return df.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")


def raw_check_stats(
    raw: DataFrame,
    *,
    scope: str = "batch",
    valid_countries: list[str] = SEED_COUNTRY_CODES,
    dates: DataFrame | None = None,
    as_of=None,
) -> DataFrame:
    """Counts behind the raw-load suite, one row per scope of ``raw``.

    Scope is ``batch_id`` (batch mode; rows of no batch are no part of it) or ``pipeline_run_id`` (legacy run mode).
    Every scope has one reference date: the one ``dates`` (batch_id, expected_date; in run mode the id of the run)
    expects of it, else the latest its rows name. It is the scope's primary partition; in batch mode an ``event_date``
    after it is future-dated, in run mode one after ``as_of`` (today by default)."""
    key = "batch_id" if scope == "batch" else "pipeline_run_id"
    raw = raw.where(F.col(key).isNotNull())
    if dates is None:
        named = F.coalesce(F.max("processing_date"), F.to_date(F.max("ingested_at")))
        dates = raw.groupBy(key).agg(named.alias("expected_date")).withColumnRenamed(key, "batch_id")
    dates = dates.groupBy(F.col("batch_id").alias("_scope")).agg(F.max("expected_date").alias("_ref"))
    raw = raw.join(dates, F.col(key) == F.col("_scope"), "left")
    primary = F.coalesce(F.col("event_date") == F.col("_ref"), F.lit(False))
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    future = F.col("event_date") > (F.col("_ref") if scope == "batch" else today)
    required_missing = reduce(
        lambda a, b: a | b,
        [
            F.col(c).isNull()
            for c in [
                "event_id",
                "event_name",
                "event_timestamp",
                "event_date",
                "ingested_at",
                "source_file",
                "pipeline_run_id",
            ]
        ],
    )
    # Level 1: (scope, event_id) with partial aggregation: distinct ids and
    # duplicate groups fall out of level 2 without a second pass over raw.
    per_id = raw.groupBy(F.col(key).alias("scope"), "event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(primary).alias("primary"),
        F.count_if(~primary).alias("other"),
        F.count_if(required_missing).alias("req_missing"),
        F.count_if(F.col("batch_id").isNull()).alias("batch_null"),
        F.count_if(F.col("user_id").isNull()).alias("user_null"),
        F.count_if(~F.col("country_code").isin(*valid_countries)).alias("bad_country"),
        F.count_if(future).alias("future"),
        F.count_if(F.col("event_date") < F.to_date("event_timestamp")).alias("late"),
    )
    s = per_id.groupBy("scope").agg(
        F.sum("n").alias("rows"),
        F.count(F.col("event_id")).alias("distinct_ids"),
        F.count_if(F.col("event_id").isNotNull() & (F.col("n") > 1)).alias("dup_groups"),
        *[F.sum(c).alias(c) for c in ["primary", "other", "req_missing", "batch_null", "user_null", "bad_country", "future", "late"]],
    )
    return s


def raw_validation(
    raw: DataFrame,
    *,
    scope: str = "batch",
    expected_rows: int = STANDARD_BATCH_ROWS,
    valid_countries: list[str] = SEED_COUNTRY_CODES,
    duplicate_event_ids: int = 2 * ANOMALY_PROFILE["duplicate_pairs"],
    dates: DataFrame | None = None,
    as_of=None,
) -> DataFrame:
    """Raw-load suite for every scope of ``raw`` (12 checks in batch scope, 11 in run scope, then the overall verdict:
    in batch mode without the five anomaly checks, in run mode over all), from one stats pass."""
    s = raw_check_stats(raw, scope=scope, valid_countries=valid_countries, dates=dates, as_of=as_of)
    dup_groups_expected = duplicate_event_ids // 2
    rows = F.col("rows")
    checks = [
        ("row_count", rows == expected_rows, expected_rows, rows),
        ("partition_presence", F.col("primary") > 0, None, "primary"),
        ("schema_required_fields", F.col("req_missing") == 0, 0, "req_missing"),
    ]
    if scope == "batch":
        checks.append(("batch_id_populated", F.col("batch_null") == 0, 0, F.col("batch_null")))
    checks += [
        (
            "distinct_event_ids",
            F.col("distinct_ids") == expected_rows - dup_groups_expected,
            expected_rows - dup_groups_expected,
            F.col("distinct_ids"),
        ),
        ("duplicate_rows", rows - F.col("distinct_ids") == dup_groups_expected, dup_groups_expected, rows - F.col("distinct_ids")),
        ("duplicates", F.col("dup_groups") == 0, dup_groups_expected, F.col("dup_groups")),
        ("null_user_ids", F.col("user_null") == 0, ANOMALY_PROFILE["null_user_ids"], F.col("user_null")),
        (
            "invalid_country_codes",
            F.col("bad_country") == 0,
            ANOMALY_PROFILE["invalid_country_codes"],
            F.col("bad_country"),
        ),
        ("future_timestamps", F.col("future") == 0, ANOMALY_PROFILE["future_timestamps"], F.col("future")),
        ("partition_reconciliation", F.col("primary") + F.col("other") == rows, rows, F.col("primary") + F.col("other")),
        ("late_arriving_events", F.col("late") == 0, ANOMALY_PROFILE["late_arriving_events"], F.col("late")),
    ]
    counted = [c for c in checks if scope != "batch" or c[0] not in ANOMALY_CHECKS]
    overall = reduce(lambda a, b: a & b, [c[1] for c in counted])
    structs = [check(*c) for c in checks] + [check("overall", overall, None, None)]
    return stack_checks(s, ["scope"], structs)


def acceptance_checks(stats: DataFrame) -> DataFrame:
    """Exact-count acceptance of the five anomaly detections plus the summary
    (PASS iff all five pass), per scope, from :func:`raw_check_stats`."""
    items = [
        ("acceptance_duplicate_detection", "dup_groups", ANOMALY_PROFILE["duplicate_pairs"]),
        ("acceptance_null_user_detection", "user_null", ANOMALY_PROFILE["null_user_ids"]),
        ("acceptance_invalid_country_detection", "bad_country", ANOMALY_PROFILE["invalid_country_codes"]),
        ("acceptance_future_timestamp_detection", "future", ANOMALY_PROFILE["future_timestamps"]),
        ("acceptance_late_arrival_detection", "late", ANOMALY_PROFILE["late_arriving_events"]),
    ]
    checks = [(n, F.coalesce(F.col(c), F.lit(0)) == e, e, F.coalesce(F.col(c), F.lit(0))) for n, c, e in items]
    summary = reduce(lambda x, y: x & y, [c[1] for c in checks])
    structs = [check(*c) for c in checks] + [check("acceptance_summary", summary, None, None)]
    return stack_checks(stats, ["scope"], structs)


LAYER_COUNTS = ["raw_rows", "classified_rows", "accepted_rows", "rejected_rows", "fact_rows", "bad_processing_dates", "lineage_missing"]


def layer_counts(scope, raw: DataFrame, classified: DataFrame, accepted: DataFrame, rejected: DataFrame, fact_ids: DataFrame,
                 expected: DataFrame | None = None, profile: dict[str, Column] | None = None) -> DataFrame:
    """One row per scope with the counts of every layer, from one grouped sum over all layers' rows.

    ``scope`` is a column over a layer; rows where it is NULL are left out. ``fact_ids`` (event_id, fact_n) counts fact rows
    per id; they are booked on the scope of the accepted row. ``expected`` (batch_id, expected_date) adds the scopes that
    must be there and judges raw processing dates; ``profile`` adds counts over classified rows."""
    names = [*LAYER_COUNTS, *(profile or {})]

    def part(df: DataFrame, key: Column, **counts: Column) -> DataFrame:
        return df.select(key.alias("scope"), *[counts.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    lineage = F.col("event_id").isNull() | F.col("pipeline_run_id").isNull()
    parts = [
        part(classified, scope, classified_rows=one, lineage_missing=flag(lineage), **{n: flag(c) for n, c in (profile or {}).items()}),
        part(accepted, scope, accepted_rows=one),
        part(rejected, scope, rejected_rows=one),
        part(accepted.select("event_id", scope.alias("_scope")).join(fact_ids, "event_id"), F.col("_scope"), fact_rows=F.col("fact_n")),
    ]
    if expected is None:
        parts.append(part(raw, scope, raw_rows=one))
    else:  # a row per scope and date meets the expected dates
        dated = raw.groupBy(scope.alias("_scope"), "processing_date").agg(F.count(one).alias("n"))
        dated = dated.join(expected.select(F.col("batch_id").alias("_scope"), "expected_date"), "_scope", "left")
        wrong = ~F.coalesce(F.col("processing_date") == F.col("expected_date"), F.lit(False))
        parts.append(part(dated, F.col("_scope"), raw_rows=F.col("n"), bad_processing_dates=F.when(wrong, F.col("n")).otherwise(0)))
        parts.append(part(expected, F.col("batch_id")))
    rows = reduce(DataFrame.unionByName, parts).where(F.col("scope").isNotNull())
    return rows.groupBy("scope").agg(*[F.sum(n).alias(n) for n in names])


def fact_ids_of(fact: DataFrame) -> DataFrame:
    return fact.groupBy("event_id").agg(F.count(F.lit(1)).alias("fact_n"))


def warehouse_validation(
    raw: DataFrame,
    classified: DataFrame,
    accepted: DataFrame,
    rejected: DataFrame,
    fact: DataFrame,
    dim_users: DataFrame,
    dim_countries: DataFrame,
    mart: DataFrame,
    batch_dates: DataFrame | None = None,
) -> DataFrame:
    """Warehouse reconciliation: six batch-scoped checks for every batch and
    four global checks (batch_id NULL rows), then the overall verdict per batch
    over all ten. ``batch_dates`` (batch_id, expected_date) names the batches that
    must be there: one without rows fails ``batch_nonempty``.

    Per-batch counts are one grouped sum over all layers; fact rows per accepted id come
    from a pre-aggregated fact key count, so the fact is never joined row-by-row. The
    global figures are one-row aggregates. A batch's expected date is one per batch, never
    the row's own."""
    has_batch = F.col("batch_id").isNotNull()
    if batch_dates is None:
        batch_dates = raw.filter(has_batch).groupBy("batch_id").agg(F.max("processing_date").alias("expected_date"))
    fact_ids = fact_ids_of(fact)
    batch_dates = batch_dates.groupBy("batch_id").agg(F.max("expected_date").alias("expected_date"))
    batches = layer_counts(F.col("batch_id"), raw, classified, accepted, rejected, fact_ids, batch_dates).withColumnRenamed("scope", "batch_id")
    batch_checks = [
        ("batch_nonempty", F.col("raw_rows") > 0, None, "raw_rows"),
        ("raw_equals_classification", F.col("raw_rows") == F.col("classified_rows"), "raw_rows", "classified_rows"),
        (
            "accepted_plus_rejected_equals_raw",
            F.col("accepted_rows") + F.col("rejected_rows") == F.col("raw_rows"),
            "raw_rows",
            F.col("accepted_rows") + F.col("rejected_rows"),
        ),
        ("accepted_equals_fact", F.col("fact_rows") == F.col("accepted_rows"), "accepted_rows", "fact_rows"),
        ("processing_date_semantics", F.col("bad_processing_dates") == 0, 0, "bad_processing_dates"),
        ("batch_lineage_semantics", F.col("lineage_missing") == 0, 0, "lineage_missing"),
    ]
    users = fact.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    countries = fact.groupBy("country_code").agg(F.count(F.lit(1)).alias("n"))
    figures = [
        fact_ids.agg(F.count_if(F.col("fact_n") > 1).alias("dup_ids"), F.coalesce(F.sum("fact_n"), F.lit(0)).alias("fact_total")),
        orphan_users(users, dim_users).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_users")),
        orphan_countries(countries, dim_countries).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_countries")),
        mart.agg(F.coalesce(F.sum("event_count"), F.lit(0)).cast("bigint").alias("mart_total")),
    ]
    whole = reduce(lambda x, y: x.join(y, "k"), [f.withColumn("k", F.lit(1)) for f in figures])  # one row each
    global_checks = [
        ("fact_event_ids_unique", F.col("dup_ids") == 0, 0, "dup_ids"),
        ("fact_user_fk_resolves", F.col("orphan_users") == 0, 0, "orphan_users"),
        ("fact_country_fk_resolves", F.col("orphan_countries") == 0, 0, "orphan_countries"),
        ("mart_totals_reconcile", F.col("mart_total") == F.col("fact_total"), "fact_total", "mart_total"),
    ]
    # the one row of global figures rides along with the batches, and with a row of no batch that reports them:
    # the fact is evaluated once
    global_ok = reduce(lambda x, y: x & y, [c[1] for c in global_checks])
    none = raw.sparkSession.range(1).select(F.lit(None).cast("string").alias("batch_id"), *[F.lit(0).cast("bigint").alias(n) for n in LAYER_COUNTS])
    batches = batches.unionByName(none).withColumn("k", F.lit(1)).join(whole.withColumn("global_ok", global_ok), "k")
    overall = reduce(lambda x, y: x & y, [c[1] for c in batch_checks]) & F.col("global_ok")
    own = [check(*c) for c in batch_checks] + [check("overall", overall, None, None)]
    shared = [check(*c) for c in global_checks]
    report = F.when(F.col("batch_id").isNotNull(), F.array(*own)).otherwise(F.array(*shared))
    return batches.select("batch_id", F.explode(report).alias("c")).select("batch_id", "c.*")


def orphan_users(fact: DataFrame, dim_users: DataFrame) -> DataFrame:
    """Fact rows whose non-null user is missing from dim_users."""
    return fact.filter(F.col("user_id").isNotNull()).join(dim_users.select("user_id"), "user_id", "left_anti")


def orphan_countries(fact: DataFrame, dim_countries: DataFrame) -> DataFrame:
    """Fact rows whose country (NULL included) has no dim row."""
    d = dim_countries.select("country_code").withColumn("_hit", F.lit(True))
    return fact.join(d, "country_code", "left").filter(F.col("_hit").isNull()).drop("_hit")


def anomaly_flags() -> dict[str, Column]:
    """What a classified row adds to each count of the anomaly profile."""
    return {
        "duplicate_extra_count": F.col("is_within_batch_duplicate"),
        "null_user_count": F.col("user_id").isNull(),
        "invalid_country_count": ~F.col("is_valid_country"),
        "future_dated_count": F.col("is_future_dated"),
        "event_time_late_count": F.col("is_event_time_late_arriving"),
        "backdated_event_date_count": F.col("is_backdated_event_date"),
        "date_timestamp_mismatch_count": F.col("has_event_date_timestamp_mismatch"),
        "missing_processing_date_count": F.col("processing_date").isNull(),
    }


def anomaly_profile(classified: DataFrame, scope_col: str = "batch_scope") -> DataFrame:
    """Seven flag counts and the missing-processing-date count per scope."""
    scoped = classified.withColumn(scope_col, F.coalesce("batch_id", "pipeline_run_id"))
    return scoped.groupBy(scope_col).agg(*[F.count_if(c).alias(n) for n, c in anomaly_flags().items()])


def recon_violations(
    raw: DataFrame,
    classified: DataFrame,
    accepted: DataFrame,
    rejected: DataFrame,
    fact: DataFrame,
    mart: DataFrame,
    *,
    inject_failure: bool = False,
) -> DataFrame:
    """The singular reconciliation tests as violation rows
    ``(test_name, batch_scope, metric, observed, expected)``; empty = pass.

    Evaluated for every batch scope (batch_id, else pipeline_run_id) at once."""
    scope = F.coalesce("batch_id", "pipeline_run_id")
    fact_ids = fact_ids_of(fact)
    counts = layer_counts(scope, raw, classified, accepted, rejected, fact_ids, profile=anomaly_flags())
    missing_dates = F.col("missing_processing_date_count")

    def viol(name: str, metric: str, observed: Column, expected, cond: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(name).alias("test_name"), F.lit(metric).alias("metric"), observed.cast("bigint").alias("observed"),
                (expected if isinstance(expected, Column) else F.lit(expected)).cast("bigint").alias("expected"),
            ),
        )

    a, f, r, rj, c = (F.col(x) for x in ["accepted_rows", "fact_rows", "raw_rows", "rejected_rows", "classified_rows"])
    exp = {
        "duplicate_extra_count": ANOMALY_PROFILE["duplicate_pairs"],
        "null_user_count": ANOMALY_PROFILE["null_user_ids"],
        "invalid_country_count": ANOMALY_PROFILE["invalid_country_codes"],
        "date_timestamp_mismatch_count": ANOMALY_PROFILE["late_arriving_events"],
    }
    temporal = {
        "future_dated_count": ANOMALY_PROFILE["future_timestamps"],
        "event_time_late_count": 0,
        "backdated_event_date_count": ANOMALY_PROFILE["late_arriving_events"],
    }
    any_bad = reduce(lambda x, y: x | y, [F.col(m) != e for m, e in exp.items()]) | (
        (missing_dates == 0) & reduce(lambda x, y: x | y, [F.col(m) != e for m, e in temporal.items()])
    )
    there = c > 0  # the anomaly profile is that of classified rows
    found = [
        viol("assert_batch_fact_reconciliation", "fact_rows", f, a, a != f),
        viol("assert_fact_rejected_reconciliation", "accepted_plus_rejected", a + rj, r, r != a + rj),
        viol("assert_raw_classification_reconciliation", "classification_rows", c, r, r != c),
        *[viol("assert_source_anomaly_profile", m, F.col(m), e, there & any_bad) for m, e in exp.items()],
        *[viol("assert_source_anomaly_profile", m, F.col(m), e, there & any_bad & (missing_dates == 0)) for m, e in temporal.items()],
    ]
    by_scope = counts.select(F.col("scope").alias("batch_scope"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    columns = ["test_name", "batch_scope", "metric", "observed", "expected"]
    parts = [by_scope.select("batch_scope", "v.*").select(*columns)]
    fact_total = fact_ids.agg(F.coalesce(F.sum("fact_n"), F.lit(0)).alias("fact_rows")).withColumn("k", F.lit(1))
    mart_total = mart.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("mart_total")).withColumn("k", F.lit(1))
    parts.append(
        fact_total.join(mart_total, "k")
        .filter(F.col("fact_rows") != F.col("mart_total"))
        .select(
            F.lit("assert_mart_fact_reconciliation").alias("test_name"),
            F.lit(None).cast("string").alias("batch_scope"),
            F.lit("mart_event_total").alias("metric"),
            F.col("mart_total").cast("bigint").alias("observed"),
            F.col("fact_rows").cast("bigint").alias("expected"),
        )
    )
    out = reduce(DataFrame.unionByName, parts)
    if inject_failure:
        spark = raw.sparkSession
        out = out.unionByName(
            spark.createDataFrame(
                [("assert_inject_failure", None, "failure_injected", 1, 0)],
                "test_name string, batch_scope string, metric string, observed bigint, expected bigint",
            )
        )
    return out

"""Registered queries: quality suites, reconciliations and generic tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.operators import generic_tests as gt
from lakeward.operators import suites
from lakeward.operators.publish import dim_countries
from lakeward.plans.oracle import with_core
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table


def stack_sql(src: str, keys: str, checks: list[tuple[str, str, str, str]]) -> str:
    """UNION ALL of one SELECT per check over ``src`` (oracle side)."""
    parts = [
        f"SELECT {keys}, '{n}' AS check_name, CASE WHEN {p} THEN 'PASS' ELSE 'FAIL' END AS status, "
        f"CAST({e} AS BIGINT) AS expected, CAST({a} AS BIGINT) AS actual FROM {src}"
        for n, p, e, a in checks
    ]
    return "\nUNION ALL ".join(parts)


BDATES_CTE = """bdates AS (SELECT 'b-' || strftime(ts, '%Y%m%d') || sfx AS batch_id, CAST(min(ts) AS DATE) AS expected_date
             FROM events, (VALUES (''), ('-r'), ('-x')) v(sfx)
             WHERE sfx != '-r' OR event_id % 250 = 2 GROUP BY 1)"""


def raw_check_agg(key: str, future: str) -> str:
    """Counts per scope; the reference date is the one the scope is expected to have, whatever its rows say."""
    return f"""
scoped AS (SELECT r.*, {key} AS scope, d.expected_date AS ref FROM raw r
           LEFT JOIN bdates d ON d.batch_id = 'b-' || regexp_replace({key}, '^(b|run)-', '') WHERE {key} IS NOT NULL),
per_id AS (
  SELECT scope, event_id, count(*) AS n,
    count_if(event_date = ref) AS "primary", count_if(event_date IS DISTINCT FROM ref) AS other,
    count_if(event_id IS NULL OR event_name IS NULL OR event_timestamp IS NULL OR event_date IS NULL
             OR ingested_at IS NULL OR source_file IS NULL OR pipeline_run_id IS NULL) AS req_missing,
    count_if(batch_id IS NULL) AS batch_null,
    count_if(user_id IS NULL) AS user_null,
    count_if(country_code NOT IN ('US','CA','GB','AU','DE','FR','BR','MX','IN','JP')) AS bad_country,
    count_if({future}) AS future,
    count_if(event_date < CAST(event_timestamp AS DATE)) AS late
  FROM scoped GROUP BY 1, 2
),
s AS (
  SELECT scope, sum(n) AS rws, count(event_id) AS distinct_ids,
    count_if(event_id IS NOT NULL AND n > 1) AS dup_groups,
    sum("primary") AS pri, sum(other) AS other, sum(req_missing) AS req_missing, sum(batch_null) AS batch_null,
    sum(user_null) AS user_null, sum(bad_country) AS bad_country, sum(future) AS future, sum(late) AS late
  FROM per_id GROUP BY 1
)"""


RAW_CHECK_AGG = raw_check_agg("r.batch_id", "event_date > ref")
RUN_AS_OF = "2024-01-20"

RAW_CHECKS = [
    ("row_count", "rws = 50000", "50000", "rws"),
    ("partition_presence", "pri > 0", "NULL", "pri"),
    ("schema_required_fields", "req_missing = 0", "0", "req_missing"),
    ("batch_id_populated", "batch_null = 0", "0", "batch_null"),
    ("distinct_event_ids", "distinct_ids = 49950", "49950", "distinct_ids"),
    ("duplicate_rows", "rws - distinct_ids = 50", "50", "rws - distinct_ids"),
    ("duplicates", "dup_groups = 0", "50", "dup_groups"),
    ("null_user_ids", "user_null = 0", "500", "user_null"),
    ("invalid_country_codes", "bad_country = 0", "200", "bad_country"),
    ("future_timestamps", "future = 0", "150", "future"),
    ("partition_reconciliation", "pri + other = rws", "rws", "pri + other"),
    ("late_arriving_events", "late = 0", "300", "late"),
]
RAW_LONG = f"raw_long AS ({stack_sql('s', 'scope', RAW_CHECKS)})"
RAW_OVERALL = """raw_report AS (
  SELECT * FROM raw_long
  UNION ALL
  SELECT scope, 'overall', CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END, NULL::BIGINT, NULL::BIGINT
  FROM raw_long WHERE check_name NOT IN
    ('duplicates','null_user_ids','invalid_country_codes','future_timestamps','late_arriving_events')
  GROUP BY scope
)"""


def expected_batches(spark, sf_dir):
    """(batch_id, expected_date): one batch per day, its replay where there is one, and a third that never landed."""
    events = read_table(spark, sf_dir, "events")
    kinds = F.array(F.lit(""), F.when(F.col("event_id") % 250 == 2, "-r"), F.lit("-x"))
    return (
        events.select("ts", F.explode(F.array_compact(kinds)).alias("sfx"))
        .groupBy(F.concat(F.lit("b-"), F.date_format("ts", "yyyyMMdd"), "sfx").alias("batch_id"))
        .agg(F.to_date(F.min("ts")).alias("expected_date"))
    )


@query("raw_validation", with_core("SELECT * FROM raw_report", BDATES_CTE, RAW_CHECK_AGG, RAW_LONG, RAW_OVERALL))
def q_raw_validation(spark, sf_dir):
    return suites.raw_validation(Pipeline(spark, sf_dir).raw, dates=expected_batches(spark, sf_dir))


@query(
    "raw_validation_run",
    with_core(
        """SELECT * FROM raw_long UNION ALL
           SELECT scope, 'overall', CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END, NULL::BIGINT, NULL::BIGINT
           FROM raw_long GROUP BY scope""",
        BDATES_CTE,
        raw_check_agg("r.pipeline_run_id", f"event_date > DATE '{RUN_AS_OF}'"),
        f"raw_long AS ({stack_sql('s', 'scope', [c for c in RAW_CHECKS if c[0] != 'batch_id_populated'])})",
    ),
)
def q_raw_validation_run(spark, sf_dir):
    """The suite per ingestion run: 11 checks, all of which count for the verdict; future dates are those after the evaluation date."""
    dates = expected_batches(spark, sf_dir).select(F.regexp_replace("batch_id", "^b-", "run-").alias("batch_id"), "expected_date")
    return suites.raw_validation(Pipeline(spark, sf_dir).raw, scope="run", dates=dates, as_of=RUN_AS_OF)


ACCEPT_SQL = """acc AS (
  SELECT scope,
    CASE check_name WHEN 'duplicates' THEN 'acceptance_duplicate_detection'
      WHEN 'null_user_ids' THEN 'acceptance_null_user_detection'
      WHEN 'invalid_country_codes' THEN 'acceptance_invalid_country_detection'
      WHEN 'future_timestamps' THEN 'acceptance_future_timestamp_detection'
      ELSE 'acceptance_late_arrival_detection' END AS check_name,
    CASE check_name WHEN 'duplicates' THEN 50 WHEN 'null_user_ids' THEN 500 WHEN 'invalid_country_codes' THEN 200
      WHEN 'future_timestamps' THEN 150 ELSE 300 END::BIGINT AS expected,
    coalesce(actual, 0)::BIGINT AS actual
  FROM raw_long
  WHERE check_name IN ('duplicates','null_user_ids','invalid_country_codes','future_timestamps','late_arriving_events')
)"""


@query(
    "acceptance_checks",
    with_core(
        """SELECT scope, check_name, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status, expected, actual
           FROM acc
           UNION ALL
           SELECT scope, 'acceptance_summary', CASE WHEN bool_and(actual = expected) THEN 'PASS' ELSE 'FAIL' END,
                  NULL::BIGINT, NULL::BIGINT FROM acc GROUP BY scope""",
        BDATES_CTE,
        RAW_CHECK_AGG,
        RAW_LONG,
        ACCEPT_SQL,
    ),
)
def q_acceptance_checks(spark, sf_dir):
    return suites.acceptance_checks(suites.raw_check_stats(Pipeline(spark, sf_dir).raw, dates=expected_batches(spark, sf_dir)))


WAREHOUSE_CTES = [
    BDATES_CTE,
    """rc AS (SELECT b.batch_id, count(r.source_file) AS raw_rows
             FROM bdates b LEFT JOIN raw r ON r.batch_id = b.batch_id GROUP BY 1)""",
    """cc AS (SELECT batch_id, count(*) AS classified_rows FROM classified WHERE batch_id IS NOT NULL GROUP BY 1)""",
    """ac AS (SELECT batch_id, count(*) AS accepted_rows FROM accepted WHERE batch_id IS NOT NULL GROUP BY 1)""",
    """jc AS (SELECT batch_id, count(*) AS rejected_rows FROM rejected WHERE batch_id IS NOT NULL GROUP BY 1)""",
    """fc AS (SELECT a.batch_id, count(*) AS fact_rows FROM fact f JOIN accepted a USING (event_id)
             WHERE a.batch_id IS NOT NULL GROUP BY 1)""",
    """pc AS (SELECT r.batch_id, count_if(r.processing_date IS NULL OR d.expected_date IS NULL
                 OR r.processing_date != d.expected_date) AS bad_processing_dates
             FROM raw r LEFT JOIN bdates d USING (batch_id) WHERE r.batch_id IS NOT NULL GROUP BY 1)""",
    """lc AS (SELECT batch_id, count_if(event_id IS NULL OR pipeline_run_id IS NULL) AS lineage_missing
             FROM classified WHERE batch_id IS NOT NULL GROUP BY 1)""",
    """b AS (
      SELECT rc.batch_id, coalesce(raw_rows, 0) AS raw_rows, coalesce(classified_rows, 0) AS classified_rows,
        coalesce(accepted_rows, 0) AS accepted_rows, coalesce(rejected_rows, 0) AS rejected_rows,
        coalesce(fact_rows, 0) AS fact_rows, coalesce(bad_processing_dates, 0) AS bad_processing_dates,
        coalesce(lineage_missing, 0) AS lineage_missing
      FROM rc LEFT JOIN cc USING (batch_id) LEFT JOIN ac USING (batch_id) LEFT JOIN jc USING (batch_id)
        LEFT JOIN fc USING (batch_id) LEFT JOIN pc USING (batch_id) LEFT JOIN lc USING (batch_id))""",
    "per_batch AS ("
    + stack_sql(
        "b",
        "batch_id",
        [
            ("batch_nonempty", "raw_rows > 0", "NULL", "raw_rows"),
            ("raw_equals_classification", "raw_rows = classified_rows", "raw_rows", "classified_rows"),
            ("accepted_plus_rejected_equals_raw", "accepted_rows + rejected_rows = raw_rows", "raw_rows", "accepted_rows + rejected_rows"),
            ("accepted_equals_fact", "fact_rows = accepted_rows", "accepted_rows", "fact_rows"),
            ("processing_date_semantics", "bad_processing_dates = 0", "0", "bad_processing_dates"),
            ("batch_lineage_semantics", "lineage_missing = 0", "0", "lineage_missing"),
        ],
    )
    + ")",
    """dims AS (SELECT DISTINCT user_id FROM accepted WHERE user_id IS NOT NULL)""",
    """g AS (
      SELECT (SELECT count(*) FROM (SELECT event_id FROM fact GROUP BY 1 HAVING count(*) > 1)) AS dup_ids,
             (SELECT count(*) FROM fact f WHERE f.user_id IS NOT NULL AND f.user_id NOT IN (SELECT user_id FROM dims)) AS orphan_u,
             (SELECT count(*) FROM fact f WHERE f.country_code IS NULL OR f.country_code NOT IN
                 ('US','CA','GB','AU','DE','FR','BR','MX','IN','JP')) AS orphan_c,
             (SELECT count(*) FROM fact) AS fact_total,
             (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM fact
               GROUP BY event_date, event_name, country_code, platform)) AS mart_total)""",
]
WAREHOUSE_SELECT = (
    "SELECT * FROM per_batch UNION ALL "
    + stack_sql(
        "g",
        "NULL::VARCHAR AS batch_id",
        [
            ("fact_event_ids_unique", "dup_ids = 0", "0", "dup_ids"),
            ("fact_user_fk_resolves", "orphan_u = 0", "0", "orphan_u"),
            ("fact_country_fk_resolves", "orphan_c = 0", "0", "orphan_c"),
            ("mart_totals_reconcile", "mart_total = fact_total", "fact_total", "mart_total"),
        ],
    )
    + """ UNION ALL SELECT batch_id, 'overall', CASE WHEN bool_and(status = 'PASS')
            AND (SELECT dup_ids = 0 AND orphan_u = 0 AND orphan_c = 0 AND mart_total = fact_total FROM g)
          THEN 'PASS' ELSE 'FAIL' END, NULL::BIGINT, NULL::BIGINT FROM per_batch GROUP BY batch_id"""
)


@query("warehouse_validation", with_core(WAREHOUSE_SELECT, *WAREHOUSE_CTES))
def q_warehouse_validation(spark, sf_dir):
    """Batches expected: one per day, its replay where there is one, and a third that never landed."""
    p = Pipeline(spark, sf_dir, materialize=True)
    expected = expected_batches(spark, sf_dir)
    return suites.warehouse_validation(
        p.raw, p.classified, p.accepted, p.rejected, p.fact, p.dim_users, dim_countries(spark), p.mart, expected
    )


# Defects as rows (scope, metric), one per flagged row and kind; metrics and expected counts as a table.
METRICS_CTE = """metrics(metric, expected, dated) AS (VALUES
    ('duplicate_extra_count', 50, false), ('null_user_count', 500, false), ('invalid_country_count', 200, false),
    ('date_timestamp_mismatch_count', 300, false), ('future_dated_count', 150, true),
    ('event_time_late_count', 0, true), ('backdated_event_date_count', 300, true),
    ('missing_processing_date_count', NULL, NULL))"""
DEFECTS_CTE = """defects AS (
    SELECT scope, unnest(list_filter([
        if(duplicate_scope = 'within_batch', 'duplicate_extra_count', NULL),
        if(user_id IS NULL, 'null_user_count', NULL),
        if(coalesce(country_code, '') NOT IN (SELECT country_code FROM seed), 'invalid_country_count', NULL),
        if(happened > seen, 'future_dated_count', NULL),
        if(happened < seen, 'event_time_late_count', NULL),
        if(event_date < seen, 'backdated_event_date_count', NULL),
        if(event_date <> happened, 'date_timestamp_mismatch_count', NULL),
        if(processing_date IS NULL, 'missing_processing_date_count', NULL)], lambda m: m IS NOT NULL)) AS metric
    FROM (SELECT *, coalesce(batch_id, pipeline_run_id) AS scope, event_timestamp::DATE AS happened,
                 coalesce(processing_date, ingested_at::DATE) AS seen FROM classified))"""
OBSERVED_CTE = """observed AS (
    SELECT s.scope, m.metric, m.expected, m.dated, count(d.metric) AS n
    FROM (SELECT DISTINCT coalesce(batch_id, pipeline_run_id) AS scope FROM classified) s CROSS JOIN metrics m
    LEFT JOIN defects d ON d.scope = s.scope AND d.metric = m.metric GROUP BY ALL)"""
ANOMALY_METRICS = [
    "duplicate_extra_count", "null_user_count", "invalid_country_count", "future_dated_count", "event_time_late_count",
    "backdated_event_date_count", "date_timestamp_mismatch_count", "missing_processing_date_count",
]
ANOMALY_SQL = (
    "SELECT scope AS batch_scope, "
    + ", ".join(f"max(n) FILTER (metric = '{m}') AS {m}" for m in ANOMALY_METRICS)
    + " FROM observed GROUP BY scope"
)


@query("anomaly_profile", with_core(ANOMALY_SQL, METRICS_CTE, DEFECTS_CTE, OBSERVED_CTE))
def q_anomaly_profile(spark, sf_dir):
    return suites.anomaly_profile(Pipeline(spark, sf_dir).classified)


RECON_CTES = [
    METRICS_CTE, DEFECTS_CTE, OBSERVED_CTE,
    """sc AS (
      SELECT coalesce(r.batch_scope, c.batch_scope, a.batch_scope, j.batch_scope, f.batch_scope) AS batch_scope,
        coalesce(raw_rows, 0) AS raw_rows, coalesce(classification_rows, 0) AS classification_rows,
        coalesce(accepted_rows, 0) AS accepted_rows, coalesce(rejected_rows, 0) AS rejected_rows,
        coalesce(fact_rows, 0) AS fact_rows
      FROM (SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, count(*) AS raw_rows FROM raw GROUP BY 1) r
      FULL JOIN (SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, count(*) AS classification_rows
                 FROM classified GROUP BY 1) c USING (batch_scope)
      FULL JOIN (SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, count(*) AS accepted_rows
                 FROM accepted GROUP BY 1) a USING (batch_scope)
      FULL JOIN (SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, count(*) AS rejected_rows
                 FROM rejected GROUP BY 1) j USING (batch_scope)
      FULL JOIN (SELECT coalesce(a.batch_id, a.pipeline_run_id) AS batch_scope, count(*) AS fact_rows
                 FROM accepted a JOIN fact f USING (event_id) GROUP BY 1) f USING (batch_scope))""",
]
RECON_SELECT = """
SELECT 'assert_batch_fact_reconciliation' AS test_name, batch_scope, 'fact_rows' AS metric,
       fact_rows::BIGINT AS observed, accepted_rows::BIGINT AS expected FROM sc WHERE accepted_rows != fact_rows
UNION ALL SELECT 'assert_fact_rejected_reconciliation', batch_scope, 'accepted_plus_rejected',
       accepted_rows + rejected_rows, raw_rows FROM sc WHERE raw_rows != accepted_rows + rejected_rows
UNION ALL SELECT 'assert_raw_classification_reconciliation', batch_scope, 'classification_rows',
       classification_rows, raw_rows FROM sc WHERE raw_rows != classification_rows
UNION ALL SELECT 'assert_mart_fact_reconciliation', NULL, 'mart_event_total', m, f
  FROM (SELECT (SELECT count(*) FROM fact) AS f,
               (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM fact
                 GROUP BY event_date, event_name, country_code, platform)) AS m) WHERE f != m
UNION ALL SELECT 'assert_source_anomaly_profile', o.scope, o.metric, o.n, o.expected
  FROM observed o
  JOIN (SELECT scope, sum(n) FILTER (metric = 'missing_processing_date_count') AS legacy FROM observed GROUP BY 1) l USING (scope)
  JOIN (SELECT a.scope FROM observed a JOIN observed m ON m.scope = a.scope AND m.metric = 'missing_processing_date_count'
        WHERE a.n <> a.expected AND (NOT a.dated OR m.n = 0) GROUP BY 1) off USING (scope)
  WHERE o.expected IS NOT NULL AND (NOT o.dated OR legacy = 0)"""


@query("recon_violations", with_core(RECON_SELECT, *RECON_CTES))
def q_recon_violations(spark, sf_dir):
    p = Pipeline(spark, sf_dir, materialize=True)
    return suites.recon_violations(p.raw, p.classified, p.accepted, p.rejected, p.fact, p.mart)


@query(
    "distinct_event_ids",
    with_core(
        """SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, count(*) AS row_count,
             count(DISTINCT event_id) AS distinct_event_ids, count(*) - count(DISTINCT event_id) AS duplicate_rows
           FROM raw GROUP BY 1"""
    ),
)
def q_distinct_event_ids(spark, sf_dir):
    raw = Pipeline(spark, sf_dir).raw
    return (
        raw.groupBy(F.coalesce("batch_id", "pipeline_run_id").alias("batch_scope"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("event_id").alias("distinct_event_ids"))
        .withColumn("duplicate_rows", F.col("row_count") - F.col("distinct_event_ids"))
    )


@query(
    "duplicate_groups",
    with_core(
        """SELECT batch_scope, count(*) AS duplicate_groups FROM (
             SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope, event_id FROM raw
             GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"""
    ),
)
def q_duplicate_groups(spark, sf_dir):
    raw = Pipeline(spark, sf_dir).raw
    scope = F.coalesce("batch_id", "pipeline_run_id").alias("batch_scope")
    return (
        raw.groupBy(scope, "event_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .groupBy("batch_scope")
        .agg(F.count(F.lit(1)).alias("duplicate_groups"))
    )


@query(
    "invalid_country_rows",
    with_core(
        """SELECT coalesce(batch_id, pipeline_run_id) AS batch_scope,
             count_if(upper(trim(country_code)) NOT IN ('US','CA','GB','AU','DE','FR','BR','MX','IN','JP'))
               AS invalid_country_rows,
             count_if(country_code IS NULL) AS null_country_rows
           FROM raw GROUP BY 1"""
    ),
)
def q_invalid_country_rows(spark, sf_dir):
    """NOT IN over the valid list: a NULL country is not counted (3-valued logic)."""
    from lakeward.schemas import SEED_COUNTRY_CODES

    raw = Pipeline(spark, sf_dir).raw
    return raw.groupBy(F.coalesce("batch_id", "pipeline_run_id").alias("batch_scope")).agg(
        F.count_if(~F.upper(F.trim("country_code")).isin(*SEED_COUNTRY_CODES)).alias("invalid_country_rows"),
        F.count_if(F.col("country_code").isNull()).alias("null_country_rows"),
    )


@query("orphan_users", with_core("SELECT event_id, user_id FROM fact WHERE user_id IS NOT NULL AND user_id::BIGINT % 50 = 3"))
def q_orphan_users(spark, sf_dir):
    """Fact rows whose user is missing from a user dimension that has lost one user in fifty."""
    p = Pipeline(spark, sf_dir)
    kept = p.dim_users.where(F.col("user_id").cast("bigint") % 50 != 3)
    return suites.orphan_users(p.fact, kept).select("event_id", "user_id")


@query(
    "orphan_countries",
    with_core(
        """SELECT event_id, country_code FROM rejected
           WHERE country_code IS NULL OR country_code NOT IN ('US','CA','GB','AU','DE','FR','BR','MX','IN','JP')"""
    ),
)
def q_orphan_countries(spark, sf_dir):
    """Country FK over the quarantine (the fact has none by construction): NULL
    countries count as orphans."""
    p = Pipeline(spark, sf_dir)
    return suites.orphan_countries(p.rejected, dim_countries(spark)).select("event_id", "country_code")


@query(
    "accepted_equals_fact",
    with_core(
        """SELECT batch_id, count(*) AS accepted_rows, count_if(event_id::BIGINT % 29 <> 4) + count_if(event_id::BIGINT % 31 = 2 AND event_id::BIGINT % 29 <> 4) AS fact_rows,
             count(*) = count_if(event_id::BIGINT % 29 <> 4) + count_if(event_id::BIGINT % 31 = 2 AND event_id::BIGINT % 29 <> 4) AS equal
           FROM accepted GROUP BY batch_id"""
    ),
)
def q_accepted_equals_fact(spark, sf_dir):
    """Accepted rows against rows of a fact table that has lost some and holds others twice."""
    p = Pipeline(spark, sf_dir, materialize=True)
    e = F.col("event_id").cast("bigint")
    fact = p.fact.where(e % 29 != 4).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.when(e % 31 == 2, 2).otherwise(1))))
    per_batch = p.accepted.select("event_id", "batch_id").join(suites.fact_ids_of(fact), "event_id", "left")
    counts = per_batch.groupBy("batch_id").agg(F.count(F.lit(1)).alias("accepted_rows"), F.coalesce(F.sum("fact_n"), F.lit(0)).alias("fact_rows"))
    return counts.withColumn("equal", F.col("accepted_rows") == F.col("fact_rows"))


@query("gt_not_null", with_core("SELECT event_id, source_file FROM raw WHERE user_id IS NULL"))
def q_gt_not_null(spark, sf_dir):
    return gt.not_null(Pipeline(spark, sf_dir).raw, "user_id").select("event_id", "source_file")


@query(
    "gt_unique",
    "SELECT o_custkey, count(*) AS n_records FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)
def q_gt_unique(spark, sf_dir):
    return gt.unique(read_table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "gt_accepted_values",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
)
def q_gt_accepted_values(spark, sf_dir):
    return gt.accepted_values(read_table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select(
        "o_orderkey", "o_orderstatus"
    )


@query(
    "gt_relationships",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem l
       WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_suppkey % 9 <> 1)""",
)
def q_gt_relationships(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "suppkey")
    suppliers = read_table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 1")  # one in nine has gone
    out = gt.relationships(li, "suppkey", suppliers, "s_suppkey")
    return out.select("l_orderkey", "l_linenumber", F.col("suppkey").alias("l_suppkey"))


@query(
    "gt_expression",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 400000)""",
)
def q_gt_expression(spark, sf_dir):
    return gt.expression_is_true(
        read_table(spark, sf_dir, "orders"), "o_totalprice < 400000", where="o_orderstatus = 'F'"
    ).select("o_orderkey", "o_totalprice")


@query(
    "gt_unique_combo",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def q_gt_unique_combo(spark, sf_dir):
    return gt.unique_combination(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "source_freshness",
    with_core(
        """SELECT max(ingested_at) AS max_loaded_at,
             date_sub('second', max(ingested_at), TIMESTAMP '2024-02-01 00:00:00') AS age_seconds,
             CASE WHEN max(ingested_at) IS NULL THEN 'error'
                  WHEN date_sub('second', max(ingested_at), TIMESTAMP '2024-02-01 00:00:00') >= 172800 THEN 'error'
                  WHEN date_sub('second', max(ingested_at), TIMESTAMP '2024-02-01 00:00:00') >= 86400 THEN 'warn'
                  ELSE 'pass' END AS status
           FROM raw"""
    ),
)
def q_source_freshness(spark, sf_dir):
    import datetime as dt

    return gt.source_freshness(Pipeline(spark, sf_dir).raw, dt.datetime(2024, 2, 1))

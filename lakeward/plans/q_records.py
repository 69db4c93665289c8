"""Registered queries: JSON records (event versions, log contract), vocabularies, run
summaries, persisted check results, rollback decisions, snapshots, retention, ids.

Lines and audit rows are derived from the driver's tables by rules on their ids;
the oracles say from those rules what must come out, without reading JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.operators import ops, records
from lakeward.plans.q_ledger import O_LEDGER, ledger
from lakeward.plans.q_suites import q_warehouse_validation
from lakeward.plans.registry import ORACLES, query
from lakeward.sources.tables import read_table


def event_lines(spark, d):
    """events -> JSON lines; the last digit of the id picks what the line says of its version."""
    e = F.col("event_id")
    says = F.when(e % 10 == 1, ',"schema_version":2,"client_app_version":"1.2"')
    says = says.when(e % 10 == 2, ',"schema_version":"two"').when(e % 10 == 3, ',"schema_version":7')
    says = says.when(e % 10 == 4, ',"client_app_version":"1.2"').when(e % 10 == 5, ',"schema_version":2,"hue":1,"color":"red"')
    says = says.when(e % 10 == 6, ',"schema_version":" 2 "').when(e % 10 == 7, ',"schema_version":2.9,"session_id":null')
    says = says.when(e % 10 == 8, ',"schema_version":"2.0"').otherwise("")
    line = F.concat(
        F.lit('{"event_id":"'), e.cast("string"), F.lit('","event_type":"'), "event_type", F.lit('","user_id":'),
        F.col("user_id").cast("string"), says, F.when(e % 110 == 9, "").otherwise("}"),
    )
    return read_table(spark, d, "events").select(e.alias("line_no"), line.alias("line"))


@query(
    "normalize_event_versions",
    """WITH r AS (
      SELECT *, event_id % 10 AS k,
        CASE WHEN event_id % 110 = 9 THEN 'not_an_object' WHEN event_id % 10 IN (2, 8) THEN 'version_not_an_integer'
             WHEN event_id % 10 = 3 THEN 'version_unsupported' WHEN event_id % 10 IN (4, 5) THEN 'unknown_fields' END AS reason
      FROM events)
    SELECT event_id AS line_no, CASE WHEN reason IS NULL THEN event_id::VARCHAR END AS event_id,
      CASE WHEN reason IS NULL THEN event_type END AS event_type, CASE WHEN reason IS NULL THEN user_id::VARCHAR END AS user_id,
      CASE WHEN k = 1 THEN '1.2' END AS client_app_version,
      CASE WHEN reason IS NULL THEN CASE WHEN k IN (1, 6, 7) THEN 2 ELSE 1 END END AS schema_version,
      NULL::VARCHAR AS session_id, reason,
      CASE k WHEN 4 THEN 'client_app_version' WHEN 5 THEN 'color,hue' END AS unknown_fields
    FROM r""",
)
def q_normalize_event_versions(spark, d):
    return records.normalize_event_versions(event_lines(spark, d)).select(
        "line_no", "event_id", "event_type", "user_id", "client_app_version", "schema_version", "session_id", "reason",
        "unknown_fields",
    )


def log_lines(spark, d):
    """events -> log lines with unknown severities and fields, wrong types, long details, and lines cut short."""
    e = F.col("event_id")
    severity = F.when(e % 7 == 0, ',"severity":"error"').when(e % 7 == 1, ',"severity":"Fatal"').when(e % 7 == 2, "")
    duration = F.when(e % 5 == 0, "true").when(e % 5 == 1, '" 12 "').when(e % 5 == 2, '"12.5"').when(e % 5 == 3, "12.5").otherwise("null")
    line = F.concat(
        F.lit('{"platform_event":true,"event_type":"'), "event_type", F.lit('"'), severity.otherwise(',"severity":"WARNING"'),
        F.lit(',"duration_ms":'), duration, F.when(e % 11 == 0, ',"color":"red"').otherwise(""),
        F.when(e % 19 == 0, ',"shade":null,"error_type":null').otherwise(""),
        F.when(e % 13 == 0, ',"error_message":"  it broke "').otherwise(""),
        F.when(e % 17 == 0, F.concat(F.lit(',"details":{"t":"'), F.repeat(F.lit("x"), F.lit(5000)), F.lit('"}')))
        .when(e % 17 == 1, ',"details":{"t":1}').otherwise(""),
        F.when(e % 101 == 3, "").otherwise("}"),
    )
    return read_table(spark, d, "events").select(e.alias("line_no"), line.alias("line"))


O_LOGS = """WITH r AS (SELECT *, event_id AS e, event_id % 101 = 3 AS bad FROM events),
logs AS (
  SELECT e AS line_no, bad AS rejected, CASE WHEN NOT bad THEN event_type END AS event_type,
    CASE WHEN NOT bad THEN CASE e % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' WHEN 2 THEN 'INFO' ELSE 'WARNING' END END AS severity,
    CASE WHEN NOT bad THEN CASE e % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 3 THEN 12 END END AS duration_ms,
    CASE WHEN NOT bad AND e % 13 = 0 THEN 'it broke' END AS error_message,
    CASE WHEN bad THEN NULL WHEN e % 17 = 1 THEN '{"t":1}'
         WHEN e % 17 = 0 THEN '{"truncated":true,"preview":"{\\"t\\":\\"' || repeat('x', 3994) || '"}' END AS details,
    CASE WHEN NOT bad THEN concat_ws(',', CASE WHEN e % 7 = 1 THEN 'severity:FATAL' END,
      CASE WHEN e % 11 = 0 THEN 'field:color' END, CASE WHEN e % 5 = 2 THEN 'type:duration_ms' END) END AS contract_violations
  FROM r)
"""
_LOG_COLUMNS = ["line_no", "rejected", "event_type", "severity", "duration_ms", "error_message", "details", "contract_violations"]


@query("log_contract", O_LOGS + "SELECT * FROM logs")
def q_log_contract(spark, d):
    return records.log_contract(log_lines(spark, d)).select(*_LOG_COLUMNS)


@query("log_errors_and_retries", O_LOGS + "SELECT line_no, severity, event_type FROM logs WHERE severity = 'ERROR'")
def q_log_errors(spark, d):
    return records.log_errors_and_retries(records.log_contract(log_lines(spark, d))).select("line_no", "severity", "event_type")


@query(
    "vocab_violations",
    """WITH a AS (
      SELECT o_orderkey AS recovery_id, o_orderkey % 3 AS s, o_orderkey % 5 AS v, o_orderkey % 23 = 4 AS odd_action FROM orders)
    SELECT recovery_id, 'action_type' AS violation FROM a WHERE odd_action
    UNION ALL SELECT recovery_id, 'status' FROM a WHERE s = 2
    UNION ALL SELECT recovery_id, 'verification_status' FROM a WHERE v = 1
    UNION ALL SELECT recovery_id, 'success_needs_verified' FROM a WHERE s = 0 AND v <> 0""",
)
def q_vocab_violations(spark, d):
    """orders -> recovery actions, some with words outside their vocabularies."""
    k = F.col("o_orderkey")
    actions = read_table(spark, d, "orders").select(
        k.alias("recovery_id"),
        F.when(k % 23 == 4, "GUESS").otherwise("BACKFILL").alias("action_type"),
        F.when(k % 3 == 0, "SUCCESS").when(k % 3 == 1, "FAILED").alias("status"),
        F.when(k % 5 == 0, "VERIFIED").when(k % 5 == 1, "MAYBE").when(k % 5 == 2, "PENDING").alias("verification_status"),
    )
    return records.vocab_violations(actions, ["recovery_id"], records.recovery_rules())


@query(
    "vocab_violations_all",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS r FROM lineitem)
       SELECT 'runs' AS rows_of, 'run-' || k AS id, 'status' AS violation FROM o WHERE k % 31 = 5
       UNION ALL SELECT 'deployments', 'dep-' || k, 'deployment_type' FROM o WHERE k % 5 <> 0
       UNION ALL SELECT 'deployments', 'dep-' || k, 'status' FROM o WHERE k % 37 = 2
       UNION ALL SELECT 'task_events', 'run-' || k || '/task_' || n, 'event_type' FROM l WHERE k % 41 = 3
       UNION ALL SELECT 'task_events', 'run-' || k || '/task_' || n, 'attempt' FROM l WHERE n = 7
       UNION ALL SELECT 'quality_results', 'run-' || k || '/check_' || n, 'check_category' FROM l WHERE n % 3 = 1
       UNION ALL SELECT 'quality_results', 'run-' || k || '/check_' || n, 'severity' FROM l WHERE r = 'R' AND n % 2 = 0
       UNION ALL SELECT 'quality_results', 'run-' || k || '/check_' || n, 'status' FROM l WHERE k % 43 = 1
       UNION ALL SELECT 'evaluations', 'run-' || k || '/check_' || n, 'status' FROM l WHERE k % 43 = 1
       UNION ALL SELECT 'evaluations', 'run-' || k || '/check_' || n, 'severity' FROM l WHERE r = 'R' AND n % 2 = 0
       UNION ALL SELECT 'jobs', 'job-' || k || '-' || n, 'component' FROM l WHERE k % 47 = 4 OR n = 6""",
)
def q_vocab_violations_all(spark, d):
    """Audit rows of six kinds against their vocabularies, with words outside of them planted in each."""
    k, n = F.col("_k"), F.col("_n")
    orders = read_table(spark, d, "orders").withColumn("_k", F.col("o_orderkey"))
    lines = read_table(spark, d, "lineitem").withColumns({"_k": F.col("l_orderkey"), "_n": F.col("l_linenumber")})
    state = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SUCCESS").otherwise("RUNNING")
    runs = orders.select(F.concat(F.lit("run-"), k.cast("string")).alias("id"), F.when(k % 31 == 5, "DONE").otherwise(state).alias("status"))
    deployed = orders.select(
        F.concat(F.lit("dep-"), k.cast("string")).alias("id"), F.when(k % 37 == 2, F.lit(None)).otherwise(state).alias("status"),
        F.when(k % 5 == 0, "rollback").otherwise("release").alias("deployment_type"),
    )
    place = F.concat(F.lit("run-"), k.cast("string"), F.lit("/task_"), n.cast("string"))
    tasks = lines.select(place.alias("id"), F.when(k % 41 == 3, "BEGUN").otherwise("STARTED").alias("event_type"), F.when(n == 7, 0).otherwise(n).alias("attempt"))
    checks = lines.select(
        F.concat(F.lit("run-"), k.cast("string"), F.lit("/check_"), n.cast("string")).alias("id"),
        F.when(n % 3 == 1, "OTHER").otherwise("RECONCILIATION").alias("check_category"),
        F.when(k % 43 == 1, "UNKNOWN").when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("status"),
        F.when((F.col("l_returnflag") == "R") & (n % 2 == 0), "SEVERE").otherwise("INFO").alias("severity"),
    )
    jobs = lines.select(
        F.concat(F.lit("job-"), k.cast("string"), F.lit("-"), n.cast("string")).alias("id"),
        F.when(k % 47 == 4, "reporting").when(n == 6, F.lit(None)).otherwise("audit").alias("component"),
    )
    kinds = [
        ("runs", runs, records.run_rules()), ("deployments", deployed, records.deployment_rules()), ("task_events", tasks, records.task_event_rules()),
        ("quality_results", checks, records.quality_rules()), ("evaluations", checks, records.evaluation_rules()), ("jobs", jobs, records.cost_label_rules()),
    ]
    parts = [records.vocab_violations(rows, ["id"], rules).select(F.lit(name).alias("rows_of"), "id", "violation") for name, rows, rules in kinds]
    return reduce(DataFrame.unionByName, parts)


@query(
    "finalizer_reconcile",
    """WITH s AS (
      SELECT o_orderkey AS k, 'run-' || o_orderkey AS pipeline_run_id,
             CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' END AS status FROM orders),
    c AS (SELECT *, k % 9 = 0 AS gone, k % 10 = 1 AS other_batch, k % 8 = 3 AS other_status FROM s),
    m AS (SELECT *, CASE WHEN gone THEN 'missing audit row' ELSE concat_ws(',', CASE WHEN other_batch THEN 'batch_id mismatch' END,
                 CASE WHEN other_status THEN 'status mismatch' END) END AS mismatches FROM c)
    SELECT pipeline_run_id, mismatches, mismatches = '' AS reconciled, status AS local_status,
           CASE WHEN gone THEN NULL WHEN other_status THEN 'ABORTED' ELSE status END AS audit_status,
           coalesce(status = 'FAILED', false) AS must_fail FROM m""",
)
def q_finalizer_reconcile(spark, d):
    """orders -> run summaries; the audit table lacks some of them and disagrees with others."""
    k = F.col("o_orderkey")
    runs = read_table(spark, d, "orders").select(
        k, F.concat(F.lit("run-"), k.cast("string")).alias("pipeline_run_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("batch_id"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SUCCESS").alias("status"),
    )
    audit = runs.where(k % 9 != 0).select(
        "pipeline_run_id",
        F.when(k % 10 != 1, F.col("batch_id")).alias("batch_id"),
        F.when(k % 8 == 3, "ABORTED").otherwise(F.col("status")).alias("status"),
    )
    return records.finalizer_reconcile(runs.drop("o_orderkey"), audit)


def _quality_oracle() -> str:
    """The durable form of what the warehouse suite's own oracle says."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.CHECK_CATEGORIES.items())
    return f"""SELECT batch_id, check_name,
      CASE check_name {cases} ELSE 'RECONCILIATION' END AS check_category,
      CASE WHEN status = 'FAIL' THEN 'CRITICAL' ELSE 'INFO' END AS severity, status,
      TRY_CAST(actual AS DOUBLE) AS observed_value, TRY_CAST(expected AS DOUBLE) AS expected_value,
      '{{"actual":"' || actual || '"' || coalesce(',"expected":"' || expected || '"', '') || '}}' AS details_json
      FROM ({ORACLES["warehouse_validation"]}) WHERE check_name <> 'overall'"""


@query("quality_results", _quality_oracle())
def q_quality_results(spark, d):
    return records.quality_results(q_warehouse_validation(spark, d))


@query(
    "rollback_eligibility",
    O_LEDGER
    + """, num AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS b FROM part),
    rel AS (SELECT DISTINCT p_size AS release FROM part),
    seen AS (SELECT DISTINCT release FROM rel JOIN num ON b <= release),
    pairs AS (
      SELECT release, a.migration_id, n.b FROM seen, latest a JOIN num n ON n.p_brand = a.migration_id
      WHERE a.status = 'APPLIED' AND n.b > release),
    c AS (
      SELECT seen.release, count(migration_id) AS newer_applied, count(*) FILTER (b % 5 = 0 AND b % 7 <> 0) AS breaking,
             count(*) FILTER (b % 7 = 0) AS unlisted
      FROM seen LEFT JOIN pairs USING (release) GROUP BY 1)
    SELECT *, CASE WHEN breaking > 0 THEN 'BLOCKED_BREAKING' WHEN unlisted > 0 THEN 'BLOCKED_UNLISTED' ELSE 'ELIGIBLE' END AS decision
    FROM c""",
)
def q_rollback_eligibility(spark, d):
    """A release per part size, which knows the brands numbered up to it; every seventh brand is not in the manifest."""
    b = F.substring("p_brand", 7, 9).cast("int")
    brands = read_table(spark, d, "part").select(F.col("p_brand").alias("migration_id"), b.alias("b")).distinct()
    releases = read_table(spark, d, "part").select(F.col("p_size").alias("release")).distinct()
    upto = releases.select("release", F.explode(F.sequence(F.lit(0), F.greatest("release", F.lit(0)))).alias("b"))
    applied = _applied(ledger(spark, d))
    manifest = brands.where("b % 7 <> 0").select("migration_id", (F.col("b") % 5 == 0).alias("breaking"))
    return records.rollback_eligibility(applied, upto.join(brands, "b").drop("b"), manifest)


def _applied(rows):
    return ops.ledger_latest(rows).where("status = 'APPLIED'").select("migration_id")


@query(
    "snapshot_diff",
    """WITH a AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
    b AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_partkey % 40 <> 7 GROUP BY ALL)
    SELECT *, 1 AS copies FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT *, -1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def q_snapshot_diff(spark, d):
    """A committed count per brand and type against a build that missed some parts."""
    p = read_table(spark, d, "part")
    build = lambda rows: rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return records.snapshot_diff(build(p), build(p.where("p_partkey % 40 <> 7")))


@query(
    "expired_rows",
    """SELECT 'orders' AS asset, count(*) AS expired, min(o_orderdate)::DATE AS oldest FROM orders WHERE o_orderdate < DATE '1999-01-01'
    UNION ALL SELECT 'lineitem', count(*), min(l_shipdate)::DATE FROM lineitem WHERE l_shipdate < DATE '1999-01-01' - 400
    UNION ALL SELECT 'events', 0, NULL""",
)
def q_expired_rows(spark, d):
    """Rows past their retention on 1999-01-01: orders at once, line items after 400 days, events never."""
    out = None
    for asset, when, days in (("orders", "o_orderdate", 0), ("lineitem", "l_shipdate", 400), ("events", "ts", None)):
        old = records.expired_rows(read_table(spark, d, asset), when, days, "1999-01-01")
        one = old.agg(F.count(F.lit(1)).alias("expired"), F.to_date(F.min(when)).alias("oldest")).select(
            F.lit(asset).alias("asset"), "expired", "oldest"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "batch_identity",
    """SELECT o_orderkey, o_orderkey % 4 <> 1 OR o_orderpriority NOT LIKE '% %' AS valid,
      CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE 'batch-' || strftime(o_orderdate, '%Y%m%d') END AS batch_id,
      'batch-run-' || strftime(o_orderdate, '%Y%m%d') || '-manual__' || replace(o_orderpriority, ' ', '-') || '-' || o_orderkey
        AS pipeline_run_id,
      CAST('0x' || substr(sha256(strftime(o_orderdate, '%Y-%m-%d')), 1, 8) AS BIGINT) AS seed
    FROM orders""",
)
def q_batch_identity(spark, d):
    """orders -> runs; some give their batch id, and some of those are not valid."""
    runs = read_table(spark, d, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("processing_date"),
        F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderpriority")).alias("given_batch_id"),
        F.concat(F.lit("+manual__"), "o_orderpriority", F.lit("+:"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("scheduler_run_id"),
    )
    return records.batch_identity(runs).select("o_orderkey", "valid", "batch_id", "pipeline_run_id", "seed")

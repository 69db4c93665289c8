"""Registered queries: changes through real tables (refresh, repair, backfill, quarantine, added columns, keyed merge),
contracts before a write, JSON-lines scans with rejects, content-addressed landing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import contracts, ingest, publish
from lakeward.operators.versioned import VersionedTable
from lakeward.plans.oracle import FACT_COLS, with_core
from lakeward.plans.pipeline import Pipeline
from lakeward.plans.q_ingest import LOOKBACK_CTE, SPLIT_AT
from lakeward.plans.registry import query
from lakeward.session import ensure_checkpoint_dir
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import read_table

BATCH = "b-20240105"
LATE_DATE = "2024-01-08"
SCAN_DAYS = ("2024-01-10", "2024-01-12")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder for a query's table."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def fact(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).fact.drop("loaded_to_core_at", "updated_at")


def fact_table(spark: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(spark, scratch(spark, name), "event_date")


def before_split(df: DataFrame) -> DataFrame:
    return df.where(F.col("ingested_at") < F.lit(SPLIT_AT).cast("timestamp_ntz"))


@query(
    "fct_merge",
    with_core(
        f"""SELECT {FACT_COLS} FROM tgt WHERE event_id NOT IN (SELECT event_id FROM moved) UNION ALL SELECT {FACT_COLS} FROM moved""",
        LOOKBACK_CTE,
        """moved AS (SELECT * REPLACE (if(event_id::BIGINT % 7 = 0, event_date + 1, event_date) AS event_date,
                     if(event_id::BIGINT % 5 = 0, 'updated', platform) AS platform) FROM src)""",
    ),
)
def q_fct_merge(spark, d):
    """The fact table after an incremental run through the table: the lookback source re-sends rows, one in seven under
    another date (so its key leaves a partition) and one in five changed."""
    rows = fact(spark, d)
    t = fact_table(spark, "fct-merge")
    t.full_refresh(before_split(rows), operation="first load")
    source = publish.lookback_source(rows, publish.max_ingested_at(t.read()))
    e = F.col("event_id").cast("bigint")
    source = source.withColumns({
        "event_date": F.when(e % 7 == 0, F.date_add("event_date", 1)).otherwise(F.col("event_date")),
        "platform": F.when(e % 5 == 0, "updated").otherwise(F.col("platform")),
    })
    t.merge(source.select(*rows.columns))
    return t.read()


@query(
    "partial_load_repair",
    with_core(
        f"""SELECT batch_id, count(*) FILTER (WHERE NOT (batch_id = '{BATCH}' AND event_id::BIGINT % 3 = 0)) AS damaged_rows,
              CASE WHEN batch_id = '{BATCH}' THEN 'partial_error' ELSE 'skip' END AS decision_before,
              count(*) AS repaired_rows, 'skip' AS decision_after, bit_xor(raw_record_hash) AS hash_xor, batch_id <> '{BATCH}' AS unchanged
            FROM fact WHERE batch_id IS NOT NULL GROUP BY batch_id"""
    ),
)
def q_partial_load_repair(spark, d):
    """A slice of one batch is lost; counting against the manifest finds it, the batch is brought back to its source's
    rows, and every other batch keeps its content."""
    rows = fact(spark, d)
    t = fact_table(spark, "partial-load")
    t.full_refresh(rows, operation="first load")
    source = t.read(1)
    manifest = source.where("batch_id is not null").groupBy("batch_id").agg(F.count(F.lit(1)).alias("expected_rows"))
    own = source.where(F.col("batch_id") == BATCH)
    left = own.where(F.col("event_id").cast("bigint") % 3 != 0)
    t.replace_batch(BATCH, left, left.count(), operation="damage")
    t.replace_batch(BATCH, own, manifest.where(F.col("batch_id") == BATCH).first()["expected_rows"], operation="partial_load_repair")

    def state(version: int, name: str) -> DataFrame:
        now = ingest.batch_fingerprint(t.read(version), "batch_id", "raw_record_hash").where("batch_id is not null")
        found = ingest.batch_load_decision(manifest, now.select("batch_id", "row_count")).select("batch_id", "decision")
        return now.join(found, "batch_id").select("batch_id", *[F.col(c).alias(f"{c}_{name}") for c in ("row_count", "hash_xor", "hash_sum", "decision")])

    both = state(2, "before").join(state(3, "after"), "batch_id")
    return both.select(
        "batch_id", F.col("row_count_before").alias("damaged_rows"), "decision_before", F.col("row_count_after").alias("repaired_rows"),
        "decision_after", F.col("hash_xor_after").alias("hash_xor"),
        ((F.col("hash_xor_before") == F.col("hash_xor_after")) & (F.col("hash_sum_before") == F.col("hash_sum_after"))).alias("unchanged"),
    )


def by_date(df: DataFrame, version: int) -> DataFrame:
    return df.groupBy("event_date").agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor("raw_record_hash").alias("hash_xor")).withColumn(
        "version", F.lit(version)
    )


@query(
    "full_refresh",
    with_core(
        """SELECT event_date, count(*) AS row_count, bit_xor(raw_record_hash) AS hash_xor, 1 AS version FROM fact
             WHERE ingested_at < TIMESTAMP '2024-01-16 00:00:00' GROUP BY event_date
           UNION ALL
           SELECT event_date, count(*), bit_xor(raw_record_hash), 2 FROM fact GROUP BY event_date"""
    ),
)
def q_full_refresh(spark, d):
    """The fact table before and after an approved rebuild; both versions stay readable, and without approval nothing happens."""
    rows = fact(spark, d)
    t = fact_table(spark, "full-refresh")
    t.full_refresh(before_split(rows))
    try:
        t.full_refresh(rows)
    except ingest.LoadError:
        t.full_refresh(rows, approved=True)
    return by_date(t.read(1), 1).unionByName(by_date(t.read(), t.version().number))


@query(
    "additive_columns",
    with_core(
        """SELECT event_date, count(*) AS row_count, count(channel) AS with_channel, count(DISTINCT channel) AS channels FROM (
             SELECT event_date, NULL::VARCHAR AS channel FROM tgt WHERE event_id NOT IN (SELECT event_id FROM src)
             UNION ALL SELECT event_date, upper(platform) || '-app' FROM src) GROUP BY event_date""",
        LOOKBACK_CTE,
    ),
)
def q_additive_columns(spark, d):
    """A later source has one column more: the table is widened on write, partitions and rows from before read NULL."""
    rows = fact(spark, d)
    t = fact_table(spark, "additive")
    t.full_refresh(before_split(rows))
    source = publish.lookback_source(rows, publish.max_ingested_at(t.read()))
    t.merge(source.withColumn("channel", F.concat(F.upper("platform"), F.lit("-app"))), add_columns=True)
    return t.read().groupBy("event_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("channel").alias("with_channel"), F.count_distinct("channel").alias("channels")
    )


CHANGES = """SELECT strftime(event_date, '%Y-%m-%d') AS value, nullif(count(*) FILTER (WHERE {old}), 0) AS rows_before,
    nullif(count(*) FILTER (WHERE {new}), 0) AS rows_after,
    CASE WHEN count(*) FILTER (WHERE {old}) = 0 THEN 'added' WHEN count(*) FILTER (WHERE {new}) = 0 THEN 'removed'
         WHEN bool_and(({old}) = ({new})) THEN 'unchanged' ELSE 'changed' END AS change,
    bool_and(({old}) = ({new})) AS same_files FROM fact GROUP BY event_date"""


@query(
    "late_backfill",
    with_core(CHANGES.format(old=f"NOT (event_date = DATE '{LATE_DATE}' AND event_id::BIGINT % 4 = 1)", new="true")),
)
def q_late_backfill(spark, d):
    """An extra batch for an earlier date comes in after all others: only that date's partition changes, and every other
    one is proved untouched by fingerprint and by its very files."""
    rows = fact(spark, d)
    late = (F.col("event_date") == F.lit(LATE_DATE).cast("date")) & (F.col("event_id").cast("bigint") % 4 == 1)
    t = fact_table(spark, "late")
    t.full_refresh(rows.where(~late))
    t.merge(rows.where(late).withColumn("batch_id", F.lit("b-late")))
    return t.changes(1)


@query("quarantine_rewrite", with_core(CHANGES.format(old="true", new=f"batch_id IS DISTINCT FROM '{BATCH}'")))
def q_quarantine_rewrite(spark, d):
    """Taking one batch out of the fact table: which partitions were rewritten, and that the others kept their files."""
    t = fact_table(spark, "quarantine")
    t.full_refresh(fact(spark, d))
    t.quarantine_batch(BATCH)
    return t.changes(1)


@query(
    "partition_rebuild",
    with_core(CHANGES.format(old=f"NOT (event_date = DATE '{LATE_DATE}' AND event_id::BIGINT % 6 = 0)", new="true")),
)
def q_partition_rebuild(spark, d):
    """One partition has lost rows and is rebuilt from the accepted events; the others keep their files."""
    rows = fact(spark, d)
    day = F.col("event_date") == F.lit(LATE_DATE).cast("date")
    t = fact_table(spark, "rebuild")
    t.full_refresh(rows.where(~(day & (F.col("event_id").cast("bigint") % 6 == 0))))
    t.rebuild_partition(LATE_DATE, rows.where(day))
    return t.changes(1)


@query(
    "rerun_idempotency",
    with_core(
        """SELECT 'partition ' || strftime(event_date, '%Y-%m-%d') AS what, count(*) AS before_run, count(*) AS after_run,
             NOT bool_or(ingested_at >= (SELECT max(ingested_at) FROM fact) - INTERVAL 3 DAY) AS same_files, 'unchanged' AS change
           FROM fact GROUP BY event_date
           UNION ALL SELECT 'mart total', count(*), count(*), NULL, 'unchanged' FROM fact
           UNION ALL SELECT 'distinct event ids', count(DISTINCT event_id), count(DISTINCT event_id), NULL, 'unchanged' FROM fact"""
    ),
)
def q_rerun_idempotency(spark, d):
    """The incremental run again over an unchanged source: the lookback is merged into the table a second time. Its
    partitions are rewritten with the same content, the others keep their files, and mart total and ids stay."""
    rows = fact(spark, d)
    t = fact_table(spark, "rerun")
    t.full_refresh(rows)
    t.merge(publish.lookback_source(t.read(1), publish.max_ingested_at(t.read(1))))
    parts = t.changes(1, 2).select(
        F.concat(F.lit("partition "), "value").alias("what"), F.col("rows_before").alias("before_run"), F.col("rows_after").alias("after_run"), "same_files", "change"
    )

    def totals(version: int) -> DataFrame:
        now = t.read(version)
        mart = publish.daily_event_mart(now).agg(F.sum("event_count").alias("n")).select(F.lit("mart total").alias("what"), "n")
        ids = now.agg(F.count_distinct("event_id").alias("n")).select(F.lit("distinct event ids").alias("what"), "n")
        return mart.unionByName(ids)

    both = totals(1).withColumnRenamed("n", "before_run").join(totals(2).withColumnRenamed("n", "after_run"), "what")
    changed = F.when(F.col("before_run") == F.col("after_run"), "unchanged").otherwise("changed")
    return parts.unionByName(both.select("what", "before_run", "after_run", F.lit(None).cast("boolean").alias("same_files"), changed.alias("change")))


@query(
    "perf_fact_scan",
    with_core("SELECT event_name, country_code, count(*) AS events FROM fact GROUP BY 1, 2"),
)
def q_perf_fact_scan(spark, d):
    """The whole fact table as two scans, three days of it and all rows outside them, undated ones too: the bounds are
    partition filters, so no day's files are opened twice."""
    t = fact_table(spark, "scan")
    t.full_refresh(fact(spark, d))
    rows = t.read()
    inside = F.col("event_date").between(*[F.lit(x).cast("date") for x in SCAN_DAYS])
    outside = rows.where(~F.coalesce(inside, F.lit(False)))
    return publish.backfill_window(rows, *SCAN_DAYS).unionByName(outside).groupBy("event_name", "country_code").agg(F.count(F.lit(1)).alias("events"))


@query(
    "contract_violations",
    with_core(
        """SELECT 'event_name' AS column_name, 'null_value' AS violation, NULL::VARCHAR AS detail, count(*) AS row_count
             FROM stg WHERE event_id::BIGINT % 61 = 2 HAVING count(*) > 0
           UNION ALL SELECT 'source_file', 'null_value', NULL, count(*) FROM stg WHERE event_id::BIGINT % 77 = 3 HAVING count(*) > 0
           UNION ALL VALUES ('raw_record_hash', 'type_mismatch', 'string instead of bigint', NULL),
                            ('ingested_date', 'missing_column', 'date', NULL), ('debug_note', 'undeclared_column', 'int', NULL)"""
    ),
)
def q_contract_violations(spark, d):
    """The staging contract against a staging build with faults: NULLs in two required columns, a retyped, a missing and
    an undeclared column."""
    e = F.col("event_id").cast("bigint")
    broken = Pipeline(spark, d).stg.drop("ingested_date").withColumns({
        "event_name": F.when(e % 61 == 2, F.lit(None)).otherwise(F.col("event_name")),
        "source_file": F.when(e % 77 == 3, F.lit(None)).otherwise(F.col("source_file")),
        "raw_record_hash": F.col("raw_record_hash").cast("string"),
        "debug_note": F.lit(1),
    })
    return contracts.violation_counts(broken, contracts.STAGING_CONTRACT)


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw events as the JSON lines they are delivered as, with their batch."""
    raw = raw_events_from_driver(read_table(spark, d, "events"))
    return raw.select(
        F.col("event_id").cast("bigint").alias("e"), F.coalesce("batch_id", "pipeline_run_id").alias("scope"),
        F.struct(*ingest.EVENT_FIELDS).alias("event"),
    )


@query(
    "jsonl_scan",
    with_core(
        """SELECT scope, reject_reason, count(*) AS row_count, count(user_id) AS with_user, min(event_timestamp) AS first_event FROM (
             SELECT coalesce(batch_id, pipeline_run_id) AS scope,
               CASE WHEN e % 83 = 1 OR e % 89 = 2 OR e % 103 = 4 THEN 'malformed_json' WHEN e % 101 = 3 THEN 'missing_event_name' END AS reject_reason,
               CASE WHEN e % 83 = 1 OR e % 89 = 2 OR e % 103 = 4 OR e % 101 = 3 THEN NULL ELSE user_id END AS user_id,
               CASE WHEN e % 83 = 1 OR e % 89 = 2 OR e % 103 = 4 OR e % 101 = 3 THEN NULL ELSE event_timestamp END AS event_timestamp
             FROM (SELECT *, event_id::BIGINT AS e FROM raw)) GROUP BY ALL"""
    ),
)
def q_jsonl_scan(spark, d):
    """Event lines written as text and scanned again, with planted bad ones: cut off, no JSON, a field of another type,
    a required field left out; unknown fields and blank lines on top."""
    rows, e = event_lines(spark, d), F.col("e")
    event = F.col("event").withField("unknown", F.when(e % 2 == 0, F.lit(1)))
    as_line = lambda x: F.to_json(x, ingest.LINE_OPTIONS)
    line = F.when(e % 101 == 3, as_line(event.dropFields("event_name"))).otherwise(as_line(event))
    line = F.when(e % 103 == 4, as_line(event.withField("event_timestamp", F.lit("yesterday")))).otherwise(line)
    line = F.when(e % 89 == 2, F.lit("no json at all")).otherwise(line)
    line = F.when(e % 83 == 1, F.substring(F.to_json("event"), 1, 20)).otherwise(line)
    line = F.when(e % 10 == 0, F.concat(line, F.lit("\n  "))).otherwise(line)
    path = scratch(spark, "lines")
    rows.select(F.col("scope").alias("batch"), line.alias("value")).write.partitionBy("batch").text(path)
    lines = spark.read.schema("value string, batch string").text(path).withColumnRenamed("batch", "scope")
    good, rejects = ingest.split_scan(ingest.scan_event_lines(lines))
    counted = good.groupBy("scope").agg(F.count(F.lit(1)).alias("row_count"), F.count("user_id").alias("with_user"), F.min("event_timestamp").alias("first_event"))
    bad = rejects.groupBy("scope", "reject_reason").agg(F.count(F.lit(1)).alias("row_count"))
    return counted.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(
        bad.withColumns({"with_user": F.lit(0).cast("bigint"), "first_event": F.lit(None).cast("timestamp_ntz")})
    )


@query(
    "landing_conflicts",
    with_core(
        """SELECT scope AS path, count(*) FILTER (WHERE NOT cut) AS row_count,
             CASE WHEN later THEN 'new' WHEN bool_or(changed OR cut) THEN 'conflict' ELSE 'reused' END AS outcome,
             CASE WHEN later THEN 'no_manifest' WHEN bool_or(cut) THEN 'row_count_mismatch' WHEN bool_or(changed) THEN 'digest_mismatch' ELSE 'match' END AS manifest_state
           FROM (SELECT scope, day >= 20 AS later, day % 10 = 7 AND event_id::BIGINT % 3 = 0 AND day < 20 AS changed,
                        day = 12 AND event_id::BIGINT % 5 = 0 AS cut
                 FROM (SELECT *, coalesce(batch_id, pipeline_run_id) AS scope, regexp_extract(coalesce(batch_id, pipeline_run_id), '[0-9]{6}([0-9]{2})', 1)::INT AS day FROM raw))
           GROUP BY scope, later"""
    ),
)
def q_landing_conflicts(spark, d):
    """A second delivery against the ledger of the first: batches of the first 19 days were landed before; some come
    again with changed lines, one with fewer lines, the rest as they were."""
    rows = event_lines(spark, d).withColumn("day", F.regexp_extract("scope", r"[0-9]{6}([0-9]{2})", 1).cast("int"))
    e, day, event = F.col("e"), F.col("day"), F.col("event")
    first = rows.where(day < 20).select(F.col("scope").alias("path"), F.to_json(event).alias("value"))
    changed = F.to_json(event.withField("app_version", F.lit("2.0.0")))
    again = rows.where(~((day == 12) & (e % 5 == 0))).select(
        F.col("scope").alias("path"), F.when((day % 10 == 7) & (day < 20) & (e % 3 == 0), changed).otherwise(F.to_json(event)).alias("value")
    )
    return ingest.landing_outcomes(ingest.line_digests(again, "path"), ingest.line_digests(first, "path"))

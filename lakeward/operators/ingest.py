"""Landing and loading: JSONL scan/sink, enrichment, load state and decision,
batch fingerprints, keyed upserts, partition rewrites."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.operators.contracts import RAW_CONTRACT, enforced
from lakeward.schemas import EVENT_LINE, RAW_COLUMNS, REQUIRED_EVENT_FIELDS, STANDARD_BATCH_ROWS

EVENT_FIELDS = [f.name for f in EVENT_LINE.fields]
#: How lines write times: to the microsecond (Spark's own default stops at milliseconds).
LINE_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class LoadError(RuntimeError):
    """A batch cannot be loaded as requested."""


# ------------------------------------------------------------------ A1 / A12
def required_field_violations(lines: DataFrame) -> DataFrame:
    """Rows missing a required field (JSON readers cannot enforce NOT NULL)."""
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED_EVENT_FIELDS])
    return lines.filter(cond)


def scan_event_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON lines -> the declared event fields beside the other columns, and why a line is no event.

    ``reject_reason`` is NULL for a good line, else ``malformed_json`` (no JSON object, or a field of another type) or
    ``missing_<field>`` for the first required field that is absent or null; ``reject_line`` keeps such a line's text.
    Unknown fields are dropped and blank lines are no lines. One projection, so it works on a stream as on a table."""
    bad = "_corrupt_record"
    parsed = F.from_json(
        F.col(text_col), T.StructType([*EVENT_LINE.fields, T.StructField(bad, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad},
    )
    rest = [c for c in lines.columns if c != text_col]
    rows = lines.where(F.trim(text_col) != "").select(*rest, F.col(text_col).alias("_line"), parsed.alias("_p"))
    malformed = F.col("_p").isNull() | F.col(f"_p.{bad}").isNotNull()
    reason = F.when(malformed, F.lit("malformed_json"))
    for c in REQUIRED_EVENT_FIELDS:
        reason = reason.when(F.col(f"_p.{c}").isNull(), F.lit(f"missing_{c}"))
    return rows.select(
        *rest, *[F.col(f"_p.{f}").alias(f) for f in EVENT_FIELDS], reason.alias("reject_reason"), F.when(reason.isNotNull(), F.col("_line")).alias("reject_line")
    )


def split_scan(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a scan."""
    good = scanned.where("reject_reason is null").drop("reject_reason", "reject_line")
    return good, scanned.where("reject_reason is not null").drop(*EVENT_FIELDS)


def write_event_lines(df: DataFrame, path: str) -> None:
    """JSONL sink: one object per line; refuses to overwrite a landed batch."""
    df.select(*EVENT_FIELDS).write.mode("errorifexists").options(**LINE_OPTIONS).json(path)


# ------------------------------------------------------------------ A6 / A10
def line_digests(lines: DataFrame, *by: str) -> DataFrame:
    """Order-insensitive digest of text lines (``value``) per group: rows, XOR and exact sum of their hashes."""
    h = F.xxhash64(F.col("value"))
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum")
    )


def landing_outcomes(delivered: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Digests of what is delivered against what the ledger has under the same key: ``new``, ``reused`` (the same
    content) or ``conflict``, and how the manifest's identity matches (``row_count_mismatch``, ``digest_mismatch``)."""
    d, m = delivered.alias("d"), ledger.alias("l")
    there = F.col(f"l.{key}").isNotNull()
    rows = F.col("d.row_count") == F.col("l.row_count")
    same = rows & (F.col("d.hash_xor") == F.col("l.hash_xor")) & (F.col("d.hash_sum") == F.col("l.hash_sum"))
    return d.join(m, F.col(f"d.{key}") == F.col(f"l.{key}"), "left").select(
        F.col(f"d.{key}").alias(key),
        F.col("d.row_count").alias("row_count"),
        F.when(~there, "new").when(same, "reused").otherwise("conflict").alias("outcome"),
        F.when(~there, "no_manifest").when(same, "match").when(~rows, "row_count_mismatch").otherwise("digest_mismatch").alias("manifest_state"),
    )


def land_once(rows: DataFrame, path: str, ledger_path: str) -> str:
    """Land a batch's event lines under ``path``, once: ``landed``, or ``reused`` if the same content is there.

    Other content under the same path is a conflict and raises; nothing is ever overwritten. The lines are written
    beside the path and renamed when complete; the ledger entry comes last. A batch whose writer died before its
    entry is recognised by the digest of the files themselves."""
    spark = rows.sparkSession
    draft = f"{path.rstrip('/')}__draft_{uuid.uuid4().hex}"
    kinds = "path string, row_count bigint, hash_xor bigint, hash_sum string"
    try:
        write_event_lines(rows, draft)
        digest = line_digests(spark.read.text(draft)).select(F.lit(path).alias("path"), "row_count", "hash_xor", "hash_sum")
        new = digest.first()
        known = None
        if table_exists(spark, ledger_path):
            known = spark.read.schema(kinds).parquet(ledger_path).where(F.col("path") == path).first()
        entered = known is not None
        if known is None and table_exists(spark, path):
            known = line_digests(spark.read.text(path)).select(F.lit(path).alias("path"), "row_count", "hash_xor", "hash_sum").first()
        if known is not None and tuple(known) != tuple(new):
            raise LoadError(f"{path} has other content: {known['row_count']} rows there, {new['row_count']} delivered")
        if known is None:
            fs, target = hadoop_path(spark, path)
            fs.mkdirs(target.getParent())
            if not fs.rename(hadoop_path(spark, draft)[1], target):
                raise LoadError(f"{path} could not be landed")
        if not entered:
            spark.createDataFrame([tuple(new)], kinds).write.mode("append").parquet(ledger_path)
        return "landed" if known is None else "reused"
    finally:
        fs, p = hadoop_path(spark, draft)
        fs.delete(p, True)


# ------------------------------------------------------------------------ A2
def enrich(lines: DataFrame, *, ingested_at, source_file, pipeline_run_id, batch_id, processing_date) -> DataFrame:
    """Add the load metadata (one constant ``ingested_at`` per load); each may be a constant or a column."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return lines.select(
        *EVENT_FIELDS,
        as_column(ingested_at).cast("timestamp_ntz").alias("ingested_at"),
        as_column(source_file).alias("source_file"),
        as_column(pipeline_run_id).alias("pipeline_run_id"),
        as_column(batch_id).cast("string").alias("batch_id"),
        as_column(processing_date).cast("date").alias("processing_date"),
    ).select(*RAW_COLUMNS)


def append_raw(raw_rows: DataFrame, table_path: str) -> None:
    """Append to the raw table, partitioned by event_date, clustered by
    (event_name, country_code) within each partition file. A large day is split
    over several tasks."""
    (
        enforced(raw_rows, RAW_CONTRACT)
        .hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", "event_name", "country_code")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(table_path)
    )


# ------------------------------------------------------------------ A3 / A4
def batch_load_state(raw: DataFrame) -> DataFrame:
    return raw.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("pipeline_run_id").alias("distinct_runs")
    )


def batch_load_decision(expected: DataFrame, state: DataFrame, default_rows: int = STANDARD_BATCH_ROWS) -> DataFrame:
    """expected (batch_id, expected_rows) + load state -> load / skip /
    partial_error / conflicting_error. An expected count of 0 or NULL falls
    back to ``default_rows``."""
    j = expected.join(state, "batch_id", "left")
    n = F.coalesce(F.col("row_count"), F.lit(0))
    e = F.coalesce(F.nullif(F.col("expected_rows"), F.lit(0)), F.lit(default_rows)).cast("bigint")
    return j.select(
        "batch_id",
        e.alias("expected_rows"),
        n.alias("row_count"),
        F.when(n == 0, "load").when(n == e, "skip").when(n < e, "partial_error").otherwise("conflicting_error").alias(
            "decision"
        ),
    )


def raise_on_decision(decisions: DataFrame, report_path: str | None = None) -> None:
    """Raise if any batch is in an error state. The message has their number per
    state; all of them are written to ``report_path`` if given."""
    bad = decisions.filter(F.col("decision").endswith("_error"))
    counts = {r["decision"]: r["count"] for r in bad.groupBy("decision").count().collect()}  # two states at most
    if counts:
        if report_path:
            bad.write.mode("append").parquet(report_path)
        raise LoadError(f"batches in error state: {counts}" + (f", listed in {report_path}" if report_path else ""))


# ----------------------------------------------------------------------- A10
def batch_fingerprint(df: DataFrame, key: str, hash_col: str | Column) -> DataFrame:
    """Order-insensitive fingerprint per group: rows, XOR of hashes and the
    exact decimal sum of hashes (a long sum overflows; XOR alone cancels
    equal pairs)."""
    h = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


# ------------------------------------------------------------------------ H5
def keyed_upsert(
    target: DataFrame, source: DataFrame, keys: list[str], *, keep_on_match: tuple[str, ...] = ("created_at",),
    now=None,
) -> DataFrame:
    """Insert new keys (created_at = updated_at = now); on a match update every
    non-key column and updated_at, keep ``keep_on_match`` from the target.
    One full outer join on the key."""
    now_c = F.lit(now).cast("timestamp_ntz") if now is not None else F.current_timestamp().cast("timestamp_ntz")
    t, s = target.alias("t"), source.alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    j = t.join(s, on, "full_outer")
    matched_s = reduce(lambda a, b: a & b, [F.col(f"s.{k}").isNotNull() for k in keys])
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        elif c == "created_at":
            cols.append(F.coalesce(F.col("t.created_at"), now_c).alias(c))
        elif c == "updated_at":
            cols.append(F.when(matched_s, now_c).otherwise(F.col("t.updated_at")).alias(c))
        elif c in keep_on_match:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        elif c in source.columns:
            cols.append(F.when(matched_s, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}").alias(c))
    return j.select(*cols)


# ------------------------------------------------------------------- H1 write
def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path as it wants it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; every other trouble with it raises."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def _check_same_columns(target: DataFrame, source: DataFrame, partition_col: str) -> None:
    kinds = [{n: t for n, t in df.dtypes if n != partition_col} for df in (target, source)]
    if kinds[0] != kinds[1] or partition_col not in source.columns:
        raise LoadError(f"columns of the source differ from the table's: {kinds[1]} against {kinds[0]}")


def merge_into_partitioned_table(
    spark: SparkSession, table_path: str, source: DataFrame, key: str = "event_id", partition_col: str = "event_date"
) -> int:
    """Keyed upsert into a partitioned parquet table without a table format.

    The source is written once, so it is the same for every step; the touched
    partitions (with source rows, or rows whose key now moves) are known and their
    new content is complete in a sibling folder before the table is changed. Then
    they are overwritten, and those left empty are deleted. A run that dies half
    way can be run again. Refuses a source with other columns, NULL or repeated keys.
    Returns the number of partitions rewritten."""
    stage = f"{table_path.rstrip('/')}__stage_{uuid.uuid4().hex}"
    try:
        return _merge_staged(spark, table_path, source, key, partition_col, stage)
    finally:
        fs, p = hadoop_path(spark, stage)
        fs.delete(p, True)


def _merge_staged(spark: SparkSession, table_path: str, source: DataFrame, key: str, partition_col: str, stage: str) -> int:
    source.write.parquet(f"{stage}/source")
    new = spark.read.schema(source.schema).parquet(f"{stage}/source")
    if not new.where(F.col(key).isNull()).isEmpty():
        raise LoadError(f"the source holds rows without {key}")
    if not new.groupBy(key).count().filter("count > 1").isEmpty():
        raise LoadError(f"the source holds a {key} more than once")
    if not table_exists(spark, table_path):
        new.write.partitionBy(partition_col).parquet(table_path)
        touched = [r[0] for r in new.select(partition_col).distinct().collect()]  # one per partition
    else:
        _check_same_columns(spark.read.parquet(table_path), new, partition_col)
        target = spark.read.schema(new.schema).parquet(table_path)
        keys = new.select(key)
        moved_from = target.join(keys, key, "left_semi").select(partition_col)
        dates = new.select(partition_col).union(moved_from).distinct()
        touched = [r[0] for r in dates.collect()]  # one per partition
        by_value = dates.select(F.col(partition_col).alias("_touched"))
        keep = target.join(by_value, F.col(partition_col).eqNullSafe(F.col("_touched")), "left_semi").join(keys, key, "left_anti")
        keep.unionByName(new).write.partitionBy(partition_col).parquet(f"{stage}/rows")
        staged = spark.read.schema(new.schema).parquet(f"{stage}/rows")
        left = {r[0] for r in staged.select(partition_col).distinct().collect()}  # one per partition
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(table_path)
        for value in set(touched) - left:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
            fs, p = hadoop_path(spark, f"{table_path.rstrip('/')}/{partition_col}={name}")
            fs.delete(p, True)
    return len(touched)


def quarantine_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """Rows of every other batch (legacy NULL-batch rows are kept)."""
    return df.filter(F.col("batch_id").isNull() | (F.col("batch_id") != batch_id))

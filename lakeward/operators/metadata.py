"""Table-shaped metadata checks: column catalogs and schema drift.

Schemas are flattened into field tables (one row per column), so drift over
any number of tables is a full outer join plus rule expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD_SCHEMA = (
    "table_name string, column_name string, ordinal int, data_type string, is_nullable string, "
    "is_partitioning_column string"
)
DRIFT_CLASSES = ["ALLOWED", "WARNING", "BREAKING"]


def schema_fields(spark: SparkSession, tables: dict[str, DataFrame], partition_columns: dict[str, str] | None = None) -> DataFrame:
    """(table, column, ordinal, type, nullable YES/NO, partition YES/NO) for
    every column of every table (driver-side metadata, one row per column)."""
    parts = partition_columns or {}
    rows = [
        (t, f.name, i + 1, f.dataType.simpleString(), "YES" if f.nullable else "NO", "YES" if parts.get(t) == f.name else "NO")
        for t, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def columns_per_table(fields: DataFrame) -> DataFrame:
    return fields.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))


def schema_drift(
    expected: DataFrame, live: DataFrame, expected_partitions: DataFrame, allowed_new: list[str] | None = None
) -> DataFrame:
    """Findings (table_name, column_name, classification, rule).

    expected_partitions: (table_name, partition_column) for every expected
    table (NULL partition column when unpartitioned)."""
    allowed = allowed_new or []
    live_tables = live.select("table_name").distinct().withColumn("_live", F.lit(True))
    missing = (
        expected_partitions.join(live_tables, "table_name", "left_anti")
        .select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("BREAKING").alias("classification"),
                F.lit("missing_table").alias("rule"))
    )
    e = expected.join(expected_partitions, "table_name").join(live_tables, "table_name", "left_semi").alias("e")
    l = live.join(expected_partitions.select("table_name"), "table_name", "left_semi").alias("l")
    j = e.join(l, (F.col("e.table_name") == F.col("l.table_name")) & (F.col("e.column_name") == F.col("l.column_name")), "full_outer")
    tname = F.coalesce("e.table_name", "l.table_name")
    cname = F.coalesce("e.column_name", "l.column_name")
    in_e, in_l = F.col("e.column_name").isNotNull(), F.col("l.column_name").isNotNull()
    is_allowed = cname.isin(*allowed) | F.concat_ws(".", tname, cname).isin(*allowed)
    f = lambda c, r: F.when(c, F.struct(F.lit(r[0]).alias("classification"), F.lit(r[1]).alias("rule")))
    findings = F.array_compact(
        F.array(
            f(in_e & ~in_l, ("BREAKING", "removed_field")),
            f(in_e & in_l & (F.col("e.data_type") != F.col("l.data_type")), ("BREAKING", "type_change")),
            f(in_e & in_l & (F.col("e.is_nullable") == "NO") & (F.col("l.is_nullable") == "YES"),
              ("BREAKING", "required_made_nullable")),
            f(in_e & in_l & (F.col("e.partition_column") == F.col("e.column_name"))
              & (F.col("l.is_partitioning_column") != "YES"), ("BREAKING", "partition_change")),
            f(~in_e & in_l & is_allowed, ("ALLOWED", "approved_new_field")),
            f(~in_e & in_l & ~is_allowed & (F.col("l.is_nullable") == "YES"), ("WARNING", "unapproved_new_field")),
            f(~in_e & in_l & ~is_allowed & (F.col("l.is_nullable") != "YES"), ("BREAKING", "unapproved_required_field")),
        )
    )
    col_findings = j.select(tname.alias("table_name"), cname.alias("column_name"), F.explode(findings).alias("x")).select(
        "table_name", "column_name", "x.classification", "x.rule"
    )
    return missing.unionByName(col_findings)


def drift_summary(findings: DataFrame) -> DataFrame:
    """Counts per classification, zero-filled."""
    spark = findings.sparkSession
    vocab = spark.createDataFrame([(c,) for c in DRIFT_CLASSES], "classification string")
    counts = findings.groupBy("classification").agg(F.count(F.lit(1)).alias("findings"))
    return vocab.join(counts, "classification", "left").na.fill(0, ["findings"])

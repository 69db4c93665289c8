"""Table contracts: declared columns as data, violations as rows, and writes that refuse what breaks them.

A contract lists (name, type, nullable). Columns are checked before anything
runs; NOT NULL columns are checked by the write itself, inside its one pass over
the rows, so a write never needs a second scan to be sure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.schemas import RAW_EVENTS, REQUIRED_EVENT_FIELDS


class ContractError(ValueError):
    """Columns or rows break a table's contract."""


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[tuple[str, str, bool], ...]  # name, type as Spark writes it, nullable

    @property
    def required(self) -> list[str]:
        return [n for n, _, nullable in self.columns if not nullable]


def contract_of(name: str, schema: T.StructType, required: list[str]) -> Contract:
    return Contract(name, tuple((f.name, f.dataType.simpleString(), f.name not in required) for f in schema.fields))


# The landed columns that must be there, and the staging layer's declared columns.
RAW_CONTRACT = contract_of("raw_events", RAW_EVENTS, [*REQUIRED_EVENT_FIELDS, "ingested_at", "source_file", "pipeline_run_id"])
STAGING_CONTRACT = Contract(
    "stg_events",
    (
        ("event_id", "string", False),
        ("user_id", "string", True),
        ("event_name", "string", False),
        ("event_timestamp", "timestamp_ntz", False),
        ("event_date", "date", False),
        ("country_code", "string", True),
        ("platform", "string", True),
        ("app_version", "string", True),
        ("ingested_at", "timestamp_ntz", False),
        ("source_file", "string", False),
        ("pipeline_run_id", "string", False),
        ("batch_id", "string", True),
        ("processing_date", "date", True),
        ("raw_record_hash", "bigint", False),
        ("event_timestamp_date", "date", False),
        ("ingested_date", "date", False),
        ("is_future_dated", "boolean", False),
        ("is_event_time_late_arriving", "boolean", False),
        ("is_backdated_event_date", "boolean", False),
        ("has_event_date_timestamp_mismatch", "boolean", False),
    ),
)


def column_violations(df: DataFrame, contract: Contract) -> list[tuple[str, str, str]]:
    """(column, violation, detail): missing, retyped and undeclared columns. Reads no rows."""
    have = dict(df.dtypes)
    found = []
    for name, kind, _ in contract.columns:
        if name not in have:
            found.append((name, "missing_column", kind))
        elif have[name] != kind:
            found.append((name, "type_mismatch", f"{have[name]} instead of {kind}"))
    declared = {n for n, _, _ in contract.columns}
    return found + [(n, "undeclared_column", t) for n, t in df.dtypes if n not in declared]


def row_violations(df: DataFrame, contract: Contract, *keys: Column) -> DataFrame:
    """``keys``, ``column_name``, ``violation``: one row per NULL in a NOT NULL column. One pass, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in contract.required]))
    return df.select(*keys, F.explode(broken).alias("column_name"), F.lit("null_value").alias("violation"))


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """``column_name``, ``violation``, ``detail``, ``row_count`` over columns and rows; no rows if the contract holds."""
    spark = df.sparkSession
    columns = column_violations(df, contract)
    structure = spark.createDataFrame(columns, "column_name string, violation string, detail string").withColumn(
        "row_count", F.lit(None).cast("bigint")
    )
    there = set(df.columns)
    rows = row_violations(df, Contract(contract.name, tuple(c for c in contract.columns if c[0] in there)))
    counts = rows.groupBy("column_name", "violation").agg(F.count(F.lit(1)).alias("row_count"))
    return structure.unionByName(counts.withColumn("detail", F.lit(None).cast("string")))


def enforced(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` in the contract's column order, to be written. Broken columns raise here, a NULL in a NOT NULL
    column raises in the task that meets it, so the write fails before it is committed."""
    if broken := column_violations(df, contract):
        raise ContractError(f"{contract.name}: " + "; ".join(f"{c}: {v} ({d})" for c, v, d in broken))

    def checked(name: str, nullable: bool) -> Column:
        c = F.col(f"`{name}`")
        if nullable:
            return c
        return F.coalesce(c, F.raise_error(F.lit(f"contract {contract.name}: {name} is NULL")).cast(df.schema[name].dataType)).alias(name)

    return df.select(*[checked(n, nullable) for n, _, nullable in contract.columns])

"""Declarative column tests as DataFrames of failing rows (empty = pass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Non-null values seen more than once, with their multiplicity."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .filter(F.col("n_records") > 1)
    )


def accepted_values(df: DataFrame, column: str, values: list, *, negate: bool = False) -> DataFrame:
    """Rows whose value is outside (``negate``: inside) the list; NULL passes."""
    hit = F.col(column).isin(*values)
    return df.filter(hit if negate else ~hit)


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null child keys with no parent row (shuffle anti join on the key)."""
    p = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(p, column, "left_anti")


def expression_is_true(df: DataFrame, expression: str | Column, where: str | Column | None = None) -> DataFrame:
    """Rows where the expression is false (a NULL result is not flagged)."""
    e = F.expr(expression) if isinstance(expression, str) else expression
    if where is not None:
        df = df.filter(F.expr(where) if isinstance(where, str) else where)
    return df.filter(~e)


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > 1)


def source_freshness(
    df: DataFrame, as_of, *, column: str = "ingested_at", warn_after_h: int = 24, error_after_h: int = 48
) -> DataFrame:
    """Age of the newest load: warn after 24 h, error after 48 h (one row)."""
    as_of_c = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    age = F.expr(f"timestampdiff(SECOND, max_loaded_at, as_of)")
    return (
        df.agg(F.max(column).alias("max_loaded_at"))
        .withColumn("as_of", as_of_c)
        .withColumn("age_seconds", age)
        .withColumn(
            "status",
            F.when(F.col("max_loaded_at").isNull(), "error")
            .when(F.col("age_seconds") >= error_after_h * 3600, "error")
            .when(F.col("age_seconds") >= warn_after_h * 3600, "warn")
            .otherwise("pass"),
        )
        .drop("as_of")
    )

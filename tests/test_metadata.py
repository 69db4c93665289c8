"""Schema drift classes over a three-column table."""

from lakeward.operators import metadata

F = metadata.FIELD_SCHEMA


def run(spark, live_rows, expected_nullable="NO", allowed=None, partition="c1", tables=("t",)):
    exp = spark.createDataFrame(
        [("t", "c1", 1, "string", expected_nullable, "YES"), ("t", "c2", 2, "bigint", "YES", "NO"),
         ("t", "c3", 3, "date", "YES", "NO")], F)
    live = spark.createDataFrame(live_rows, F)
    parts = spark.createDataFrame([(t, partition) for t in tables], "table_name string, partition_column string")
    return sorted((r.column_name, r.classification, r.rule) for r in metadata.schema_drift(exp, live, parts, allowed).collect())


BASE = [("t", "c1", 1, "string", "NO", "YES"), ("t", "c2", 2, "bigint", "YES", "NO"), ("t", "c3", 3, "date", "YES", "NO")]


def test_no_drift(spark):
    assert run(spark, BASE) == []


def test_removed_and_retyped(spark):
    live = [BASE[0], ("t", "c2", 2, "string", "YES", "NO")]
    assert run(spark, live) == [("c2", "BREAKING", "type_change"), ("c3", "BREAKING", "removed_field")]


def test_required_made_nullable_and_partition_lost(spark):
    live = [("t", "c1", 1, "string", "YES", "NO")] + BASE[1:]
    assert run(spark, live) == [("c1", "BREAKING", "partition_change"), ("c1", "BREAKING", "required_made_nullable")]


def test_new_fields(spark):
    live = BASE + [("t", "n1", 4, "string", "YES", "NO"), ("t", "n2", 5, "string", "NO", "NO"), ("t", "ok", 6, "string", "YES", "NO")]
    assert run(spark, live, allowed=["t.ok"]) == [
        ("n1", "WARNING", "unapproved_new_field"), ("n2", "BREAKING", "unapproved_required_field"),
        ("ok", "ALLOWED", "approved_new_field"),
    ]


def test_missing_table(spark):
    assert run(spark, BASE, tables=("t", "gone")) == [(None, "BREAKING", "missing_table")]

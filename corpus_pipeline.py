"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, calls one operator of ``lakeward.llm``
and returns the columns of ``documents`` (the last one returns packed pieces).

For every stage: null texts count as empty, null ids and sources are values like any
other, rows that repeat are documents of their own where the operator tells them apart
by all columns and equal ones where it compares texts, ties go to the smaller id, an
empty table gives an empty one, and further columns of any name come along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeward.llm import exact_dedup, mixing, packing, quality, simhash
from lakeward.llm.common import materialise
from lakeward.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted of their own lines go; texts stay as they are."""
    return quality.filter_quality(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints the document that names it stays."""
    return simhash.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; a document taken twice is packed twice."""
    return packing.pack(docs).withColumnRenamed("_id", "doc_id").drop("_key")


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix", source_mix),
    ("pack", packed),
]


#: Packing runs a tokenizer, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

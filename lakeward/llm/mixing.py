"""Mixing sources to target weights by systematic sampling.

Within each source the documents stand in order of size, and each is expected
``target / source size`` times (2 at most). The running sum of expected copies,
moved by one random offset, gives a document one copy per integer it crosses.
As neighbours are of like size, a source's taken words miss its target by no
more than about its longest document.

Null texts have size 0; a null source is a source of its own, last in order; a
source without words has target 0 and gives no copies. Identical rows are
interchangeable. An empty table gives an empty result. Only narrow rows are
sorted; texts are read once for their sizes.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, keep_rows, materialise, positions, row_key, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20


def offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: shares of ``share`` x all words by weight, none above ``most`` x its source.

    The weights repeat over the sources by code point. The level (words a unit
    of weight gets) rises round by round as full sources hand on their excess;
    each round is one sum over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(materialise(totals, "sources"), [], [F.col("source").asc_nulls_last()], "ranked")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    held = ranked.select(
        "source", "source_size", kinds[(F.col("_pos") % len(weights)).cast("int")].alias("w")
    ).withColumn("cap", F.col("source_size") * float(most))
    level, full = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.col("cap")
        row = held.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))
        ).first()
        if row[0] is None or row[2] is None or row[3] == full:
            break
        level, full = (share * row[0] - (row[1] or 0.0)) / row[2], row[3]
    return held.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: ``_id, _key, source, size, source_size, target, copies``."""
    sizes = materialise(
        docs.select(
            col("doc_id").alias("_id"), row_key(docs).alias("_key"), col("source").alias("source"),
            F.size(words_of(text_of())).cast("long").alias("size"),
        ),
        "sizes",
    )
    goal = materialise(targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "_source")
    order = [F.col("size"), F.col("_id").asc_nulls_last(), F.col("_key")]
    placed = positions(sizes, ["source"], order, "placed")
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rate * (F.col("_pos") + 1) + F.lit(offset(seed))) - F.floor(rate * F.col("_pos") + F.lit(offset(seed)))
    return joined.select("_id", "_key", "source", "size", "source_size", "target", crossed.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as many times as the plan says, with the columns of ``docs``."""
    times = plan(docs, **how).groupBy("_id", "_key").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    taken = keep_rows(docs, times)
    return taken.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")

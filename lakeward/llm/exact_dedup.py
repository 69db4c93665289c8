"""Exact dedup: heavy-hitter split.

Texts are equal when equal after each white-space run becomes one space. The
SHA-256 of that is written once as a narrow table; texts are not moved again.
Misra-Gries summaries, one per task, find the frequent digests; their winners
are verified by an exact count, broadcast (``SKETCH`` rows at most) and decide
those rows without bringing a group together. All other digests, none of which
can hold more than about 2 / ``SKETCH`` of the rows, take an ordinary shuffle.

Null texts count as empty, and empty texts are equal to each other. The row
with the smallest doc_id stays (null ids last, then by a hash of the whole row);
of fully identical rows one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import col, keep_rows, materialise, row_key, spaced, text_of

#: Counters of a Misra-Gries summary, and so the most digests that are ever broadcast.
SKETCH = 1024


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: ``_id, _key, sha`` (32 bytes)."""
    sha = F.unhex(F.sha2(spaced(text_of()), 256))
    return materialise(docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), sha.alias("sha")), "digests")


def misra_gries(k: int):
    """Summarise a stream of digests with at most ``k`` counters; counts are low by at most rows / (k + 1)."""

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column("sha")).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > k:
                cut = sorted(held.values(), reverse=True)[k]
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["sha", "n"]
        )

    return run


def heavy_winners(rows: DataFrame, k: int) -> DataFrame:
    """At most ``k`` rows ``sha, n, keep_id, keep_key``: exact sizes and winners of the frequent digests."""
    seen = rows.select("sha").mapInArrow(misra_gries(k), "sha binary, n bigint")
    likely = seen.groupBy("sha").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "sha").limit(k)
    hot = rows.join(F.broadcast(likely.select("sha")), "sha")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key")).alias("w")
    won = hot.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), first)
    return materialise(won.select("sha", "n", F.col("w._id").alias("keep_id"), F.col("w._key").alias("keep_key")), "heavy")


def decide(docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """One row per document: ``_id, _key, sha, keep_id, group_size, kept``."""
    rows = digests(docs)
    heavy = F.broadcast(heavy_winners(rows, sketch))
    same_row = rows.join(heavy, "sha").groupBy("sha", "_id", "_key", "n", "keep_id", "keep_key").agg(
        F.count(F.lit(1)).alias("m")
    )
    hot = same_row.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).select(
        "_id", "_key", "sha", "keep_id", F.col("n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_key") == F.col("keep_key")) & (F.col("i") == 1)).alias("kept"),
    )
    group = Window.partitionBy("sha")
    ranked = group.orderBy(F.col("_id").asc_nulls_last(), "_key")
    rest = rows.join(heavy.select("sha"), "sha", "left_anti").select(
        "_id", "_key", "sha",
        F.min("_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
    )
    return hot.unionByName(rest)


def deduplicate(docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    kept = decide(docs, sketch).where("kept").select("_id", "_key")
    return keep_rows(docs, kept).select("_row.*")

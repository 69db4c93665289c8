"""Conversation prefix trie by SQL ROLLUP.

A conversation is a row of turn-id columns, ``BLOCK`` of them at a time. One
``GROUP BY ROLLUP`` over the columns gives all prefixes within a block, told apart
by ``grouping_id()``; longer conversations continue in further rows, whose key is
the node that ends the block before. A node's key is two sums of hashes of its
(place, turn) pairs, so the key of any block comes from one running sum over the
blocks of a conversation and all blocks are rolled up together.

Subtrees need no walk: the first roll-up finds nodes, their members and their
smallest conversation; a node's cost and each childless node are booked on that
conversation, and a second ROLLUP sums the bookings over the members of every
prefix. What the smallest conversation has booked above a node is taken off again.

Turns stand in the order of ``turn`` (null first), then role and text; null roles
and texts are empty; repeated rows are turns of their own. Rows without a
conversation id belong to no conversation and are left out. Turns are numbered by
a global range sort, so a conversation of any length is spread over tasks; ids of
the conversations that end at a node are hashed as a stream, part by part. An
empty table gives no nodes, not even a root. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import col, materialise, positions, shuffle_partitions, words_of

BLOCK = 8
SHARED_EVERY = 20
#: Conversation ids of one part of a node's list.
PART = 20_000

KEY = ["k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at`` (from 0), ``turn_id``, ``words``: every turn by its place."""
    empty = F.lit("")
    role, text = F.coalesce(col("role"), empty), F.coalesce(col("text"), empty)
    rows = conversations.where(col("conv_id").isNotNull()).select(
        col("conv_id").cast("long").alias("conv_id"),
        col("turn").alias("turn"),
        F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text))).alias("turn_id"),
        F.size(words_of(text)).cast("long").alias("words"),
        role.alias("_role"),
        text.alias("_text"),
    )
    placed = positions(
        rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("_role"), F.asc("_text")], "trie-turns"
    )
    return placed.select("conv_id", F.col("_pos").alias("at"), "turn_id", "words")


def shared_head(conv_id: Column) -> Column:
    """How many first turns come from the conversation that opens the family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("long")


def rebuilt(turns: DataFrame, every: int = SHARED_EVERY) -> tuple[DataFrame, DataFrame]:
    """``(conv_id)`` of all conversations, and their turns once their first ones are those of their family's."""
    convs = turns.where("at = 0").select("conv_id")
    head = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_from"), shared_head(F.col("conv_id")).alias("_h"))
    first = turns.where(F.col("at") < 3).select(F.col("conv_id").alias("_from"), "at", "turn_id", "words")
    lent = head.join(first, "_from").where(F.col("at") < F.col("_h")).select("conv_id", "at", "turn_id", "words")
    many = lent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_lent"))
    h = shared_head(F.col("conv_id"))
    own = turns.where(F.col("at") >= h).join(many, "conv_id", "left")
    own = own.select("conv_id", (F.col("at") - h + F.coalesce("_lent", F.lit(0))).alias("at"), "turn_id", "words")
    return convs, lent.union(own)


def _hash(at: Column, turn_id: Column, seed: int) -> Column:
    return F.when(turn_id.isNotNull(), F.xxhash64(F.lit(seed), at, turn_id).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))


def blocks(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: its number ``b``, the key of the node before it, ``t0..``, and ``end1, end2, depth`` of its own end.

    A conversation has its first block even without turns.
    """
    b = F.floor(F.col("at") / block).cast("long")
    wide = turns.groupBy("conv_id", b.alias("b")).agg(
        *[F.max(F.when(F.col("at") % block == i, F.col("turn_id"))).alias(f"t{i}") for i in range(block)],
        *[F.sum(_hash(F.col("at"), F.col("turn_id"), s + 1)).alias(f"_s{s}") for s in range(2)],
        F.count(F.lit(1)).alias("_n"),
    )
    rest = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    none = rest.select(
        "conv_id", F.lit(0).cast("long").alias("b"), *[F.lit(None).cast("binary").alias(f"t{i}") for i in range(block)],
        *[F.lit(0).cast("decimal(38,0)").alias(f"_s{s}") for s in range(2)], F.lit(0).cast("long").alias("_n"),
    )
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("decimal(38,0)")
    return wide.union(none).select(
        "conv_id", "b", *[f"t{i}" for i in range(block)],
        *[F.coalesce(F.sum(f"_s{s}").over(before), zero).cast("decimal(38,0)").alias(KEY[s]) for s in range(2)],
        *[F.sum(f"_s{s}").over(upto).cast("decimal(38,0)").alias(f"end{s + 1}") for s in range(2)],
        (F.col("b") * block + F.col("_n")).alias("depth"),
    )


def _roll_up(rows: DataFrame, block: int, measures: str) -> DataFrame:
    """``k1, k2`` (the node), ``p1, p2`` (its parent), ``depth`` and the measures, for every prefix of every block."""
    t = [f"t{i}" for i in range(block)]
    rolled = rows.sparkSession.sql(
        f"""select b, k1, k2, {', '.join(t)}, grouping_id() as g, {measures}
            from {{rows}} group by b, k1, k2, rollup({', '.join(t)})""",
        rows=rows,
    )
    # grouping_id has a set bit for every column rolled away: the ones kept are the first `level`
    level = F.lit(block) - F.bit_count("g")
    deepest = F.coalesce(*[F.when(level == i + 1, F.col(t[i])) for i in range(block)])
    node = rolled.withColumn("level", level).where(
        ((F.col("level") == 0) & (F.col("b") == 0)) | deepest.isNotNull()
    )
    at = [F.col("b") * block + i for i in range(block)]
    h = lambda s, i: F.when(F.col("level") > i, _hash(at[i], F.col(t[i]), s + 1)).otherwise(F.lit(0).cast("decimal(38,0)"))
    last = lambda s: F.coalesce(*[F.when(F.col("level") == i + 1, _hash(at[i], F.col(t[i]), s + 1)) for i in range(block)])
    for s in range(2):
        whole = F.col(KEY[s])
        for i in range(block):
            whole = whole + h(s, i)
        node = node.withColumn(f"_n{s}", whole.cast("decimal(38,0)"))
    kept = [c for c in rolled.columns if c not in (*t, "b", "g", *KEY)]
    return node.select(
        *[F.col(f"_n{s}").alias(KEY[s]) for s in range(2)],
        *[(F.col(f"_n{s}") - last(s)).cast("decimal(38,0)").alias(f"p{s + 1}") for s in range(2)],
        (F.col("b") * block + F.col("level")).alias("depth"),
        *kept,
    ).drop("level")


def ends_digest(ends: DataFrame, part: int = PART) -> DataFrame:
    """``k1, k2, ends_sha256``: the ids of the conversations that end at each node, ascending, as one digest.

    A range sort deals even one node's ids over many tasks, which write them as
    text of at most ``part`` ids; the parts of a node then pass one hash in order.
    """
    placed = ends.repartitionByRange(shuffle_partitions(ends.sparkSession), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def join_ids(batches):
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=schema)

        schema = pa.schema([("k1", pa.decimal128(38, 0)), ("k2", pa.decimal128(38, 0)), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            for k1, k2, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv_id")), strict=True):
                if ids and ((k1, k2) != key or len(ids) >= part):
                    yield out()
                    ids = []
                key = (k1, k2)
                ids.append(c)
        if ids:
            yield out()

    def digest(batches):
        key, sha = None, None

        def out():
            return pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [sha.hexdigest()]}, schema=schema)

        schema = pa.schema([("k1", pa.decimal128(38, 0)), ("k2", pa.decimal128(38, 0)), ("ends_sha256", pa.string())])
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids")), strict=True):
                if (k1, k2) != key:
                    if sha:
                        yield out()
                    key, sha = (k1, k2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if sha:
            yield out()

    whole = "k1 decimal(38,0), k2 decimal(38,0)"
    parts = placed.select(*KEY, "conv_id").mapInArrow(join_ids, f"{whole}, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{whole}, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, every: int = SHARED_EVERY) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs, turns = rebuilt(materialise(ordered_turns(conversations), "trie-ordered"), every)
    turns = materialise(turns, "trie-rebuilt")
    rows = materialise(blocks(convs, turns, block), "trie-blocks")

    nodes = _roll_up(rows, block, "min(conv_id) as conv_id, count(*) as n_convs")
    last = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "words")
    nodes = nodes.join(last, ["conv_id", "depth"], "left").withColumn("cost", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0)))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes, "trie-nodes")
    nodes = materialise(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "trie-children")

    # a node is booked on its smallest conversation: its cost, and one leaf where it has no children
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("_above", F.coalesce(F.sum("cost").over(above), F.lit(0)))
    booked = nodes.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = _roll_up(
        rows.join(booked.where("cost <> 0 or leaf <> 0"), "conv_id"), block, "sum(cost) as subtree, sum(leaf) as n_leaves"
    ).select(*KEY, "subtree", "n_leaves")

    # the end of a conversation is the end of its last block
    latest = rows.groupBy("conv_id").agg(F.max(F.struct("b", "end1", "end2")).alias("e"))
    ends = ends_digest(latest.select(F.col("e.end1").alias("k1"), F.col("e.end2").alias("k2"), "conv_id"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, KEY, "left")
        .join(ends, KEY, "left")
        .join(parents, ["p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("subtree") - F.col("_above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )

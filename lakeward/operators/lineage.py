"""Lineage graphs as edge tables: extraction from SQL text, transitive closure.

Reachability is iterative frontier expansion (semi-naive evaluation) from given
start pairs; lineage is cut every round with a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.session import ensure_checkpoint_dir

# How model SQL names another model, and a source table (schema, table).
REF_PATTERN = r"\bref\(\s*['\"]([^'\"]+)['\"]\s*\)"
SOURCE_PATTERN = r"\bsource\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)"


def edges_from_sql(models: DataFrame, name_col: str = "model", sql_col: str = "sql") -> DataFrame:
    """(src, dst) edges from the models and sources (as ``schema.table``) that model SQL names."""
    sql = F.col(sql_col)
    found = F.concat(
        F.regexp_extract_all(sql, F.lit(REF_PATTERN), 1),
        F.zip_with(
            F.regexp_extract_all(sql, F.lit(SOURCE_PATTERN), 1),
            F.regexp_extract_all(sql, F.lit(SOURCE_PATTERN), 2),
            lambda schema, table: F.concat_ws(".", schema, table),
        ),
    )
    return models.select(F.explode(found).alias("src"), F.col(name_col).alias("dst")).distinct()


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst) pairs: what each ``start`` pair's far end leads to, the start pairs included.

    Each round joins the pairs found last with the edges and keeps the new ones;
    a round's pairs are written once. Ends when a round finds none, so cycles and
    paths of any length are fine. For counts alone see ``reachable_counts``."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct().checkpoint()
    found = [start.select("src", "dst").distinct().checkpoint()]
    while True:
        step = found[-1].join(e, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst")).distinct()
        new = step.join(reduce(DataFrame.union, found), ["src", "dst"], "left_anti").checkpoint()
        if new.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(new)


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) pairs with a directed path src -> ... -> dst."""
    return reach(edges, edges)


def reachable_counts(edges: DataFrame) -> DataFrame:
    """(src, reachable): how many nodes each node with an edge leads to, itself included only on a cycle.

    Most lineage is tree-like, and trees need no pairs: from the leaves up, a node whose children are all counted and
    have no other parent is counted by one sum. Each round reads only the nodes counted last and parents still waiting
    for a child. What is left is the part of the graph with shared nodes or cycles above them; only there are pairs
    followed, over nodes that carry the size of the trees hanging from them."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select("src", "dst").distinct().checkpoint()
    parents = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("parents"), F.min("src").alias("parent"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    nodes = parents.join(outs, "node", "full_outer").select(
        "node", F.coalesce("parents", F.lit(0)).alias("parents"), "parent", F.coalesce("out", F.lit(0)).alias("out")
    ).checkpoint()
    degree = nodes.select(F.col("node").alias("parent"), F.col("out").alias("need"))

    # counted: node, below (nodes reached from it); waiting: parent, have (children counted), below
    last = nodes.where("out = 0").select("node", F.lit(0).cast("bigint").alias("below")).checkpoint()
    counted = [last]
    waiting = None
    single = nodes.where("parents = 1").select("node", "parent")
    while not last.isEmpty():
        got = last.join(single, "node").groupBy("parent").agg(F.count(F.lit(1)).alias("have"), F.sum(F.col("below") + 1).alias("below"))
        if waiting is not None:
            got = got.unionByName(waiting).groupBy("parent").agg(F.sum("have").alias("have"), F.sum("below").alias("below"))
        got = got.join(degree, "parent").checkpoint()
        last = got.where("have = need").select(F.col("parent").alias("node"), "below")
        waiting = got.where("have < need").select("parent", "have", "below")
        counted.append(last)
    trees = reduce(DataFrame.union, counted)
    hanging = (waiting if waiting is not None else spark.createDataFrame([], "parent string, have bigint, below bigint")).select(
        F.col("parent").alias("node"), F.col("below").alias("hang")
    )

    # the rest: nodes that were not counted, and counted ones that they share
    rest = nodes.join(trees, "node", "left_anti").select("node")
    core = e.join(rest, F.col("src") == F.col("node"), "left_semi")
    shared = trees.join(nodes.where("parents > 1"), "node").select("node", F.col("below").alias("hang"))
    carried = rest.join(hanging, "node", "left").select("node", F.coalesce("hang", F.lit(0)).alias("hang")).unionByName(shared).checkpoint()
    core = core.join(carried, F.col("dst") == carried["node"], "left_semi").checkpoint()
    own = rest.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    if core.isEmpty():
        pairs = own.withColumn("reached", F.lit(False))
    else:
        found = transitive_closure(core)
        pairs = found.withColumn("reached", F.lit(True)).unionByName(own.withColumn("reached", F.lit(False)))
    pairs = pairs.groupBy("src", "dst").agg(F.max("reached").alias("reached"))
    counts = pairs.join(carried, F.col("dst") == F.col("node")).groupBy("src").agg(
        (F.count_if("reached") + F.sum("hang")).cast("bigint").alias("reachable")
    )
    return trees.where("below > 0").select(F.col("node").alias("src"), F.col("below").alias("reachable")).unionByName(counts)


def consumer_impact(edges: DataFrame, changed: DataFrame, consumers: DataFrame) -> DataFrame:
    """(changed, consumer, affected_node): consumers of a changed node or of
    anything downstream of it. Only the changed nodes are followed."""
    start = changed.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    hit = reach(edges, start).join(consumers.select(F.col("node").alias("dst"), "consumer"), "dst")
    return hit.select(F.col("src").alias("changed"), "consumer", F.col("dst").alias("affected_node")).distinct()

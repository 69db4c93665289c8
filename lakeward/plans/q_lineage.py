"""Registered queries: lineage edges over the driver's key graph, closure, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.operators import lineage
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table


def key_graph(spark, d):
    """region -> nation -> {supplier, customer}; customer -> order. A DAG."""
    n = read_table(spark, d, "nation")
    s = read_table(spark, d, "supplier")
    c = read_table(spark, d, "customer")
    o = read_table(spark, d, "orders")
    node = lambda kind, col: F.concat(F.lit(kind + ":"), F.col(col).cast("string"))
    return (
        n.select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst"))
        .unionByName(s.select(node("nation", "s_nationkey").alias("src"), node("supplier", "s_suppkey").alias("dst")))
        .unionByName(c.select(node("nation", "c_nationkey").alias("src"), node("customer", "c_custkey").alias("dst")))
        .unionByName(o.select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst")))
    )


O_EDGES = """WITH RECURSIVE edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
),
closure(src, dst) AS (
  SELECT src, dst FROM edges
  UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src
)
"""


@query("lineage_edges", O_EDGES + "SELECT DISTINCT src, dst FROM edges")
def q_edges(spark, d):
    return key_graph(spark, d).distinct()


@query("lineage_closure", O_EDGES + "SELECT src, count(*) AS reachable FROM closure GROUP BY 1")
def q_closure(spark, d):
    return lineage.reachable_counts(key_graph(spark, d))


@query(
    "consumer_impact",
    O_EDGES
    + """, changed AS (SELECT 'nation:' || n_nationkey AS node FROM nation WHERE n_regionkey = 1),
    consumers AS (SELECT 'supplier:' || s_suppkey AS node, 'procurement' AS consumer FROM supplier
                  UNION ALL SELECT 'nation:' || n_nationkey, 'geo-dashboard' FROM nation),
    down AS (SELECT src, dst FROM closure WHERE src IN (SELECT node FROM changed)
             UNION ALL SELECT node, node FROM changed)
    SELECT DISTINCT d.src AS changed, c.consumer, d.dst AS affected_node
    FROM down d JOIN consumers c ON c.node = d.dst""",
)
def q_impact(spark, d):
    """Consumers affected by a change to every nation of region 1."""
    n = read_table(spark, d, "nation")
    changed = n.filter(F.col("n_regionkey") == 1).select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node")
    )
    s = read_table(spark, d, "supplier")
    consumers = s.select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("procurement").alias("consumer")
    ).unionByName(
        n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"),
                 F.lit("geo-dashboard").alias("consumer"))
    )
    return lineage.consumer_impact(key_graph(spark, d), changed, consumers)


@query(
    "lineage_from_sql",
    """SELECT 'nation_' || c_nationkey AS src, 'customer_' || c_custkey AS dst FROM customer
       UNION SELECT 'raw.orders', 'customer_' || c_custkey FROM customer WHERE c_custkey % 3 = 0
       UNION SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
       UNION SELECT 'raw.region', 'nation_' || s_nationkey FROM supplier""",
)
def q_lineage_from_sql(spark, d):
    """Edges read out of model SQL, one model per customer and per (supplier, nation): references in either quote, with
    blanks, repeated, and a name that only ends like one."""
    c, s = read_table(spark, d, "customer"), read_table(spark, d, "supplier")
    text = lambda name: F.col(name).cast("string")
    customers = c.select(
        F.concat(F.lit("customer_"), text("c_custkey")).alias("model"),
        F.concat(
            F.lit("select * from {{ ref('nation_"), text("c_nationkey"), F.lit("') }} n\njoin {{ ref( \"nation_"), text("c_nationkey"),
            F.lit("\" ) }} m using (k) where my_ref('nothing')"),
            F.when(F.col("c_custkey") % 3 == 0, "\nunion all select * from {{ source('raw', \"orders\") }}").otherwise(""),
        ).alias("sql"),
    )
    suppliers = s.select(
        F.concat(F.lit("nation_"), text("s_nationkey")).alias("model"),
        F.concat(F.lit("select * from {{ source('raw','region') }} join {{ ref('supplier_"), text("s_suppkey"), F.lit("') }}")).alias("sql"),
    )
    return lineage.edges_from_sql(customers.unionByName(suppliers))

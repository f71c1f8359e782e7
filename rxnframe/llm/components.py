"""Connected components of an edge table by two-hop minima and contraction.

Every round each node takes the smallest id within two hops, pointers are followed to their ends, and edges are
rewritten between the ends. Surviving nodes are at least three hops apart, so their number halves every round
whatever the shape of the graph. Every intermediate result is a table in the shared folder. Minima are written
before they are joined, so that a join on a hub splits by skew handling; grouped minima combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import discard, table


def _relabel(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    p = parents.select(F.col("node").alias(column), F.col("parent").alias("_to"))
    return rows.join(p, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node reachable. Nulls and loops are dropped; repeats are harmless; no edges give no rows."""
    edges = edges.select("a", "b").filter("a <> b").distinct()
    edges = table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while not edges.isEmpty():
        low = table(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("low")).withColumnRenamed("a", "b"))
        near = edges.join(low, "b").groupBy("a").agg(F.min("low").alias("low"))
        parents = table(near.join(low.withColumnRenamed("b", "a").withColumnRenamed("low", "own"), "a").select(F.col("a").alias("node"), F.least("low", "own").alias("parent")))
        while True:
            far = parents
            for _ in range(3):
                far = _relabel(far.withColumn("before", F.col("parent")), "parent", parents)
            jumped = table(far)
            discard(parents)
            parents = jumped.select("node", "parent")
            parents.rxnframe_path = jumped.rxnframe_path
            if jumped.filter("before <> parent").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            before, labels = labels, table(_relabel(labels, "parent", parents))
            discard(before)
        before, edges = edges, table(_relabel(_relabel(edges, "a", parents), "b", parents).filter("a <> b").distinct())
        discard(before, low)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))

"""Connected components by contraction, as joins and aggregations over staged tables.

Each round every node hooks onto the neighbour with the least hash drawn for that round, if that is below its own;
edges are renamed to the parents and loops dropped.  A constant share of the nodes is expected to go per round
whatever the shape of the graph, chains included.  The parent tables are then composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.runtime import stage


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: one row for each node with an edge to another one; no row where there is none."""
    parents: list[DataFrame] = []
    current = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    kind = current.schema["a"].dataType.simpleString()
    while not current.isEmpty():
        draw = F.lit(len(parents))
        ends = current.union(current.select("b", "a"))
        least = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", draw).alias("draw"), "b")).alias("least"))
        own = F.struct(F.xxhash64("a", draw).alias("draw"), F.col("a").alias("b"))
        parent = stage(least.select(F.col("a").alias("node"), F.least("least", own)["b"].alias("parent")), "parents")
        parents.append(parent)
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        current = stage(current.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    if not parents:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    found = parents.pop().select("node", F.col("parent").alias("root"))
    while parents:
        above = found.select(F.col("node").alias("parent"), "root")
        found = parents.pop().join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return found

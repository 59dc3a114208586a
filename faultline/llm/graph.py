"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For edges (a, b) of long nodes: node and label, the least node of its component; one row for each node.

    In each round every node points to the least, by hash, of itself and its neighbours, and edges are drawn between what
    their ends point to; edges within one node vanish. A constant share of the nodes is left on average, whatever the
    graph's shape. Joins are with tables, so that they can be split at a node with very many edges."""
    edges = scratch.materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(c, F.lit(k))
        near = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        to = scratch.materialise(near.select(F.col("a").alias("node"), F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "points")
        steps.append(to)
        ends = [to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        edges = scratch.materialise(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    root = steps[0]
    for to in steps[1:]:
        root = root.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    root = scratch.materialise(root, "roots")
    least = scratch.materialise(root.groupBy("to").agg(F.min("node").alias("label")), "labels")
    return scratch.materialise(root.join(least, "to").select("node", "label"), "components")

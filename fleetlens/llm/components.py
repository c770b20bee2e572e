"""Connected components of an edge table by least neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Each round hangs every node below its least neighbour and follows those pointers to their ends; the edges between different
    ends are what the next round gets, and at least half of the nodes that still have edges are gone from it. Edges and labels
    stay distributed; a hub is a skewed join key that adaptive execution splits. Nulls and loops are no edges.
    """
    x, y = F.col(a), F.col(b)
    left = materialize(edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("root")))
        found = followed(materialize(ends.groupBy("node").agg(F.min("root").alias("root")), "labels"))
        further = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = found if labels is None else materialize(labels.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "labels")
        of_a, of_b = (found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        between = left.join(of_a, "a").join(of_b, "b").where("root_a != root_b")
        left = materialize(between.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels


def followed(pointers: DataFrame) -> DataFrame:
    """(node, root) with each pointer, which leads to a lesser node or to its own, followed to its end."""
    while True:
        further = pointers.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = materialize(pointers.join(further, "root").select("node", F.col("root").alias("was"), F.col("further").alias("root")), "labels")
        pointers = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return pointers

"""Connected components of an edge table, in rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import stored


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, parent) forest to (node, root): paths halve in every step."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stored(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "cc-roots")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node of the component.

    In each round every node with a smaller neighbour hooks on to the smallest of them, trees are
    flattened, and the edges between the roots go on. Everything is a pre-aggregated group-by or a
    join with one row per node; at least half of the nodes that still have edges go in a round.
    """
    left = stored(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct(), "cc-edges")
    labels = left.select(F.col("high").alias("node")).union(left.select("low")).distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        roots = forest_roots(stored(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent")), "cc-hooks"))
        renamed = roots.select(F.col("node").alias("root"), "parent")
        labels = labels.join(renamed, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        for side in ("high", "low"):
            moved = roots.select(F.col("node").alias(side), F.col("parent").alias("to"))
            left = left.join(moved, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        left = stored(left.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).where("high <> low").distinct(), "cc-edges")
    return stored(labels, "cc-labels")

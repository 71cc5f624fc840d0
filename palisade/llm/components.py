"""Connected components of a link table as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``links`` (``a``, ``b``).

    Every node points to its smallest neighbour. From there the smallest neighbour is no larger
    than the node itself, so the pointers form trees whose only cycles are a tree's smallest node
    and its own smallest neighbour: the root is the smallest node. Trees are flattened by pointing
    to the pointer's pointer, which halves their depth, and become the nodes of the next level.
    Each tree has two nodes or more, so a level has at most half the linked nodes of the one
    before, whatever the order of the names; the search ends when no link is left, without a cap.

    Minima are taken before rows are moved, and a hub is cut by the adaptive skew join, since the
    label side has one row per node. Each step is written to the shared folder; nulls are no nodes.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    levels = []
    while not edges.isEmpty():
        levels.append(_trees(edges))
        edges = materialize(_contracted(edges, levels[-1]), "links")
    if not levels:
        return edges.select(a.alias("node"), b.alias("component"))
    # From the last and smallest level back to the first.
    labels = levels.pop()
    while levels:
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = materialize(levels.pop().join(onward, "label", "left").select(
            "node", F.coalesce("beyond", "label").alias("label")), "labels")
    return labels.select("node", F.col("label").alias("component"))


def _trees(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the root of its tree of smallest neighbours."""
    both = edges.union(edges.select("b", "a"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")),
                         "labels")
    # The smaller of pointer and pointer's pointer resolves the cycle at the root.
    step = F.least("label", "beyond")
    while True:
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = materialize(labels.join(onward, "label").select(
            "node", step.alias("label"), (step != F.col("label")).alias("changed")), "labels")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels
        step = F.col("beyond")


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between different trees, each once."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    ends = edges.join(one, "a").join(two, "b").where(F.col("x") != F.col("y"))
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

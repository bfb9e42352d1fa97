"""Connected components of a large sparse graph as rounds of joins, with a checkpoint after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored


def _roots(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a > b) points at its smallest neighbour if that is smaller, and then at the
    end of the pointers that start there."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near")).select("node", F.least("node", "_near").alias("root")))
    while True:
        jump = found.select("root").distinct().join(found.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root").where("_to < root")
        # stored, so that both sides of the join are dealt out for it and Spark can split a root that many nodes share
        jump = stored(jump, "jump")
        if jump.isEmpty():
            return found
        found = cut(found.join(jump, "root", "left").select("node", F.coalesce("_to", "root").alias("root")))


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node, label): ``label`` becomes the smallest label that can be reached over ``edges`` (a, b).

    Each round merges every node with its smallest neighbour and leaves one node for what has merged, with the edges
    between such nodes, each once. So an edge inside a group is joined in one round only, and the number of rounds grows with the
    logarithm of a component's size. Only nodes that have an edge take part.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    left, rounds = cut(own.distinct()), []
    while not left.isEmpty():
        root = stored(_roots(left), "roots")
        rounds.append(root)
        ends = left.join(root.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a").select("_a", "b")
        ends = ends.join(root.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b").where("_a <> _b")
        left = cut(ends.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())
    if not rounds:
        return nodes.select("node", "label")
    found = rounds.pop()
    while rounds:
        later = stored(found.where("root < node").select(F.col("node").alias("root"), F.col("root").alias("_to")), "later")
        found = stored(rounds.pop().join(later, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")
    named = nodes.join(found, "node", "left").select("node", "label", F.coalesce("root", "node").alias("_root"))
    smallest = stored(nodes.join(found, "node").groupBy(F.col("root").alias("_root")).agg(F.min("label").alias("_label")), "labels")
    return named.join(smallest, "_root", "left").select("node", F.coalesce("_label", "label").alias("label"))

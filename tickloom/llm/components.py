"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for the nodes of edges (a, b).

    Each round sends every node to its least neighbour, or to where that one goes, and
    draws the edges anew between what is left, so that they soon become few. Each round is
    a table; at the end the rounds are followed one after the other.
    """
    near = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    near = staged(near.distinct(), "edges")
    rounds: list[DataFrame] = []
    while True:
        both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
        next_ = one.withColumnsRenamed({"node": "_n", "label": "_l"})
        rounds.append(staged(one.join(next_, F.col("label") == F.col("_n")).select("node", F.least("label", "_l").alias("label")), "labels"))
        dropped(one)
        to = rounds[-1]
        left = near.join(to, near["a"] == to["node"]).select("b", F.col("label").alias("x"))
        left = left.join(to, left["b"] == to["node"]).select("x", F.col("label").alias("y")).filter("x <> y")
        after = staged(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(near)
        near = after
        if near.isEmpty():
            break
    labels = rounds[0]
    for to in rounds[1:]:
        step = to.withColumnsRenamed({"node": "_n", "label": "_l"})
        labels = labels.join(step, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    return labels

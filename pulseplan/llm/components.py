"""Connected components of a table of links, by repeated random contraction.

In each round every node takes the neighbour of lowest rank (itself included) as its
representative, by a hash that changes with the round, and links are moved to the
representatives. Links within a representative vanish, and a constant share of the nodes
goes in each round, whatever the shape: chains, stars and dense groups alike.

Only minima (which combine in each task) and equi-joins are used, so a node with very
many links is never gathered. Every round writes its links and labels to the shared
folder, from where a lost executor's part is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stored


def _rank(node: str, turn: int):
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("r"), F.col(node).alias("node"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (columns ``a`` and ``b``, not null).

    Nodes of one component share the label, which is one of them.
    """
    links = stored(links.select("a", "b").filter("a != b").distinct(), "links")
    labels, turn = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_rank("b", turn)).alias("best"))
        least = F.least(F.col("best"), _rank("a", turn))
        step = stored(best.select(F.col("a").alias("node"), least["node"].alias("to")), "steps")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.withColumnRenamed("node", "label")
            labels = labels.join(moved, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
        labels = stored(labels, "labels")
        to_a = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        to_b = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(to_a, "a").join(to_b, "b").filter("to_a != to_b")
        pair = (F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links, turn = stored(moved.select(*pair).distinct(), "links"), turn + 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels

"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtable.plans.shared import spill


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the chains of hooks, and
    contracts the edges to the hooked roots, so the edge table shrinks until it is empty.  Both
    tables stay distributed; each round's are stored in the shared folder.  A hub with very many
    neighbours is reduced by map-side minima before any shuffle.
    """
    live = spill(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        hooks = spill(hooks.select("node", F.least("node", "least").alias("root")), "hooks")
        roots = spill(_shorten(_shorten(hooks)), "roots")
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            moved = roots.select(F.col("node").alias("component"), "root")
            labels = labels.join(moved, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            )
        labels = spill(labels, "labels")
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = live.join(left, "a").join(right, "b").where("ra != rb")
        live = spill(
            contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges"
        )
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _shorten(hooks: DataFrame) -> DataFrame:
    """Replace each hook by the hook of the node it points to."""
    upper = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return hooks.join(upper, "root").select("node", F.col("above").alias("root"))

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import park
from sluicebox.storage import drop


def _flat(hooks: DataFrame) -> DataFrame:
    """(a, p) with every p replaced by the root that it leads to, two steps a round. hooks, a parked table, is
    deleted, and so are the tables between."""
    while True:
        one = hooks.select(F.col("a").alias("a1"), F.col("p").alias("p1"))
        two = hooks.join(one, F.col("p") == F.col("a1")).select("a", F.col("p1").alias("p"), (F.col("p") != F.col("p1")).alias("moved"))
        before, hooks = hooks, park(two, "flat")
        drop(before)
        if hooks.filter("moved").isEmpty():
            return hooks.select("a", "p")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node in links (a, b): comp is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, flattens the chains, and contracts the links to those
    between different roots; the number of nodes that still have links falls by half a round at least. All tables
    are parked, so each round starts from written files, and a node with very many links is summed before it moves.
    Tables that no later round reads are deleted.
    """
    edges = park(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = park(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "hooks")
        hooks = _flat(hooks)
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            moved = labels.join(hooks, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("p", "comp").alias("comp"))
            labels = park(moved, "labels")
        left, right = (hooks.select(F.col("a").alias(f"k{x}"), F.col("p").alias(x)) for x in ("x", "y"))
        rest = edges.join(left, F.col("a") == F.col("kx")).join(right, F.col("b") == F.col("ky")).filter("x <> y")
        before, edges = edges, park(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(before)
        if edges.isEmpty():
            return labels

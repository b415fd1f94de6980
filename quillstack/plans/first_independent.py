"""The first independent set of a graph, in the order of its nodes' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import kept


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that a greedy pass in the order of ids would take: those without an edge to one taken before.

    In each round the open nodes that have no smaller open neighbour are taken, and their neighbours
    are closed; what a greedy pass does to a node depends on smaller neighbours only, so the result is the same. Rounds
    are as many as the longest chain of such dependences: with the logarithm of the nodes in a random
    order, and one for two nodes in a path along the order. edges: (a, b), each once, in any direction."""
    open_nodes = kept(nodes.select("id").distinct())
    edges = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    taken = None
    while not edges.isEmpty():
        behind = edges.select(F.col("b").alias("id")).distinct()
        now = kept(open_nodes.join(behind, "id", "left_anti"))
        taken = now if taken is None else taken.union(now)
        closed = edges.join(now, edges["a"] == now["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        open_nodes = kept(open_nodes.join(now, "id", "left_anti").join(closed, "id", "left_anti"))
        left = edges.join(open_nodes, edges["a"] == open_nodes["id"], "left_semi")
        edges = kept(left.join(open_nodes, left["b"] == open_nodes["id"], "left_semi"))
    return open_nodes if taken is None else taken.union(open_nodes)

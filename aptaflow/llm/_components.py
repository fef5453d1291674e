"""Connected components of large graphs, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, for each node in an edge.

    Each round every node points to its smallest neighbour if that is smaller, the pointers are doubled until they reach
    roots, and the edges are drawn anew between roots. At least half of the nodes that still have edges vanish in a round.
    Each step is one minimum by key or one join with a table of unique keys, written to the shared folder. Null ends and
    loops are ignored; a loop alone makes no node.
    """
    edges = edges.select("a", "b").filter("a <> b")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = None
    while not edges.isEmpty():
        up = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")))
        while True:
            nxt = cut(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to"), (F.col("then") < F.col("to")).alias("moved")))
            up = nxt.select("node", "to")
            if nxt.filter("moved").isEmpty():
                break
        if found is None:
            found = up.select("node", F.col("to").alias("component"))
        else:
            found = found.join(up.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = cut(edges.filter("a <> b").distinct())
        found = cut(found)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found

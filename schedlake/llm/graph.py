"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from schedlake.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for each end of an edge ``(a, b)`` the smallest node that it is connected to.

    Every node hooks onto its smallest neighbour if that is smaller, and edges move to the hooks until none is left. A
    node with a third of all edges costs no more than another: edges are reduced to minima before they are shuffled.
    Each round is a table in the shared folder.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    hooks = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("to")), "hooks")
        hooks.append(hook)
        moved = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(
            hook.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        edges = written(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = hooks[0].select("node", F.col("to").alias("component"))
    for hook in hooks[1:]:
        out = out.join(hook.select(F.col("node").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
    return out

"""Connected components by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylantern.llm.common import discard, settle


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, component (the smallest node) of all nodes of edges (a, b).

    In each round every node hooks to its smallest neighbour and the edges are rewritten between the nodes hooked to, so
    at least half of the nodes that still have edges go. Tables are written between rounds; the driver sees only
    whether edges are left. Minima are pre-aggregated and the rewriting joins have plain exchanges on both sides, so a
    node with a third of all edges is split. files: of each table at most.
    """
    edges = settle(edges.filter("a <> b").distinct(), "edges", files)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("hook")), "hooks", files)
        if labels is None:
            labels = settle(hooks.withColumnRenamed("hook", "component"), "labels", files)
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "component"), "component", "left")
            before, labels = labels, settle(moved.select("node", F.coalesce("hook", "component").alias("component")), "labels", files)
            discard(before)
        left = edges.join(hooks.selectExpr("node AS a", "hook AS x"), "a").join(hooks.selectExpr("node AS b", "hook AS y"), "b")
        done, edges = edges, settle(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", files)
        discard(done)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

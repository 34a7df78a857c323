"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import durable, forget


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of comparable ids to ``(node, component)`` with the smallest id reachable.

    Each round maps every node to the least id among itself and its
    neighbours, rewrites the edges, and drops those that became loops; a star
    takes one round and a path about a logarithm of its length.  A node of any
    degree costs one aggregated row per map task.  Null ends, loops and
    repeated edges are ignored; no edges give an empty result.
    """
    live = durable(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    labels = durable(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(rounds):
        if live.isEmpty():
            return labels
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        least = durable(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("to")), "least")
        moved = least.where("to < node")
        left = live.join(moved.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a", "left")
        ends = left.join(moved.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b", "left").select(
            F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")
        )
        fresh = durable(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        renamed = labels.join(moved.select(F.col("node").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
        next_labels = durable(renamed, "labels")
        for old in (live, labels, least):
            forget(old)
        live, labels = fresh, next_labels
    raise RuntimeError(f"components did not settle within {rounds} rounds")

"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforge.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Each round, a node takes the smallest label among its neighbours and then the label of its label,
    so a path of n nodes takes about log n rounds. Labels meet in aggregations that are combined in the
    tasks, so a node with very many neighbours is no hot key. Every round is written to the shared
    folder; the driver sees one count per round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "graph-edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node")
    labels = materialise(labels, "graph-labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "node")
        )
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        moved = hooked.join(up, "low", "left").select(
            "node", F.least("low", F.coalesce("up", "low")).alias("next"), "component"
        )
        moved = materialise(moved, "graph-labels")
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.where("next <> component").limit(1).count() == 0:
            return labels

"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (node, low); a component is its least node.

    Each round points every node at its least neighbour and contracts the edges, until
    none is left.  Every step is an aggregation or an equi-join, so a node with a third
    of all edges is pre-aggregated or split; each round ends in a written table.
    """
    edges = written(edges.where("node <> low").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("low").alias("node"), F.col("node").alias("low")))
        point = both.groupBy("node").agg(F.least(F.min("low"), F.col("node")).alias("to"))
        point = written(point, "pointers")
        if labels is None:
            labels = point.select("node", F.col("to").alias("component"))
        else:
            step = point.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        labels = written(labels, "labels")
        ends = point.select(F.col("node").alias("low"), F.col("to").alias("end"))
        contracted = (
            edges.join(point, "node").select("low", F.col("to").alias("start"))
            .join(ends, "low").select(F.col("start").alias("node"), F.col("end").alias("low"))
        )
        edges = written(contracted.where("node <> low").distinct(), "edges")
    if labels is None:
        return edges.select("node", F.col("low").alias("component"))
    return labels

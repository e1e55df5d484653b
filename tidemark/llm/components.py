"""Connected components of a sparse link table, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node; links (a, b) in any direction.

    Each round every linked node takes the smallest label around it and then its label's label, so
    the number of rounds grows with the logarithm of the longest path. Nodes without links never
    enter a round. State is cut to the shared checkpoint folder; only a count reaches the driver.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("higher"))
        step = step.join(up, step.label == up.at, "left").select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label"))
        step = cut(step)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            break
    return nodes.distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))

"""Connected components of star edges, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import materialized


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (hub long, node long); a component is named by its least node.

    Each node first gives up all hubs but one, so the edges are about as many as the nodes. Labels only fall: a hub takes the least label among its nodes, its nodes take that of the hub, and every label then jumps to
    the label of the node that it names, so long chains shrink quickly. Each table of a round is written to the shared
    folder, so a join has plain scans on both sides and Spark can split a hub with very many nodes. The driver sees one sum a round.
    """
    # a node of many hubs stays with the least of them, which takes the others: alike nodes, which have hubs in common, leave those edges once
    least = edges.where("hub <> node").select("hub", "node", F.min("hub").over(Window.partitionBy("node")).alias("least"))
    led = least.select(F.col("least").alias("hub"), "node").unionByName(least.where("hub <> least").select(F.col("least").alias("hub"), F.col("hub").alias("node")))
    edges = materialized(led.distinct())
    ends = edges.select("node", F.least("hub", "node").alias("label")).unionByName(edges.select(F.col("hub").alias("node"), F.col("hub").alias("label")))
    labels = materialized(ends.groupBy("node").agg(F.min("label").alias("label")))
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while before is not None:
        own = labels.select(F.col("node").alias("hub"), "label")
        hubs = materialized(edges.join(labels, "node").select("hub", "label").unionByName(own).groupBy("hub").agg(F.min("label").alias("label")))
        fallen = edges.join(hubs, "hub").select("node", "label").unionByName(hubs.select(F.col("hub").alias("node"), "label"))
        fallen = materialized(fallen.groupBy("node").agg(F.min("label").alias("label")))
        named = fallen.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = materialized(fallen.join(named, "label").select("node", F.col("root").alias("label")))
        now = labels.agg(total).first()[0]
        if now == before:
            break
        before = now
    return labels.withColumnRenamed("label", "component")

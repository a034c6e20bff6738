"""Connected components of a graph of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.skew import SHARE
from tracewright.storage import stash


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; a component is named by its smallest node.

    Every node takes the smallest label among its neighbours', and then the label of its label, until
    nothing changes. Each round is written to the shared folder, so lost executors cost one round
    at most. Nodes with over a thousandth of all links are broadcast to the rows that
    ask for them (fewer than ``SHARE``), so they are no hot keys. Loops and repeated links change nothing; no links give
    no nodes; links with a null end are left out. Nodes are of any type with an order.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stash(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    hubs = stash(both.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") * SHARE > both.count()).select("v"), "hubs")
    labels = stash(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    to_hubs, others = both.join(F.broadcast(hubs), "v"), both.join(F.broadcast(hubs), "v", "left_anti")
    while True:
        known = labels.select(F.col("node").alias("v"), "label")
        met = to_hubs.join(F.broadcast(known.join(F.broadcast(hubs), "v")), "v").unionByName(others.join(known, "v"))
        nearest = met.groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(nearest.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        # One entry for each label there is, so the label of a large component costs rows of one side only, which Spark splits.
        jump = labels.select("label").distinct().join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        moved = moved.join(jump, "label", "left").select("node", "before", F.least("label", "next").alias("label"))
        moved = stash(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> before").isEmpty():
            return labels.withColumnRenamed("label", "component")

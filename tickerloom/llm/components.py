"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import pin


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) can reach.

    Every round takes the smallest label of all neighbours and then the label of that label, so paths shorten by
    half; rounds end when no label changes.  All state lives in tables; a hot node costs one row for each link.
    """
    both = pin(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        lower = pin(lower, "labels")
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("label"))
        labels = pin(lower.join(jump, "to").select("node", "label", "was"), "labels")
        changed = labels.where("label <> was").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels

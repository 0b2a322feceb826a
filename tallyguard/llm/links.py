"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Each round every node takes the smallest label among its neighbours and then that label's
    own label, so the rounds grow with the logarithm of the longest path. Nothing but the
    number of changes reaches the driver.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = written(
            step.join(jump, "next").select(
                "node", F.least("next", "far").alias("component"), (F.col("old") != F.least("next", "far")).alias("moved")
            )
        )
        labels = moved.select("node", "component")
        if not moved.where("moved").limit(1).count():
            return labels

"""Connected components by joins; nothing is collected but the number of labels that still change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.text import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), with the smallest node as the component.

    Each round takes the least label among neighbours and then the label's own label (pointer jumping), so long
    chains need a logarithmic number of rounds. Labels are checkpointed each round. Empty edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("seen"))
        )
        stepped = labels.join(near, "node").select("node", F.least("label", "seen").alias("step"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("next"))
        moved = cut(stepped.join(jump, "step", "left").select("node", F.least("step", F.coalesce("next", "step")).alias("label"), "old"))
        changed = moved.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))

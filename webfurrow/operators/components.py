"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``node, label``: the smallest node each node of ``edges`` (``a``, ``b``, whole numbers) is connected with.

    In a round every node takes the smallest label around it, and then the label of that label, so
    the rounds grow with the logarithm of the longest path. Labels are staged; whether one has moved is
    all that meets the driver.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    number = 0
    while True:
        number += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = better.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = stage(better.join(jump, better.label == jump.via, "left")
                      .select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), f"labels-{number}")
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels

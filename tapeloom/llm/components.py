"""Connected components of a table of links, by minimum labels with label shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import staged


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``; the label is the component's least node.

    Each round takes the least label among a node and its neighbours, then follows labels twice
    (label of label), so chains shrink by a factor a round. A node with very many links only adds
    to a minimum, which is taken before the shuffle. Every round is a written table; the number of
    changed nodes is all that reaches the driver. No links give no rows.
    """
    both = links.selectExpr("a", "b").union(links.selectExpr("b", "a"))
    edges = staged(both.distinct(), "links")
    labels = staged(
        edges.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("label")
        ),
        "labels",
    )
    while True:
        heard = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        least = labels.join(heard, "node").select(
            "node", F.least("label", "heard").alias("next"), F.col("label").alias("was")
        )
        least = staged(least, "labels")
        jump = least.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = staged(
            least.join(jump, "next", "left").select(
                "node", F.coalesce(F.least("further", "next"), "next").alias("label"), "was"
            ),
            "labels",
        )
        if moved.filter("label != was").isEmpty():
            return moved.drop("was")
        labels = moved.drop("was")

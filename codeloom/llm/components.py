"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import WorkTables


def components(edges: DataFrame, work: WorkTables) -> DataFrame:
    """(node, label) of every node that has an edge (a, b); label is the smallest
    node of its component.

    Each round takes the smallest label among neighbours and then follows labels to
    their own label, so that long chains shrink by powers of two.  A round is one
    written table; the loop ends when a round changes nothing.
    """
    loop = work.child()
    both = loop.keep(
        edges.select("a", "b").unionByName(
            edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        ).filter("a <> b").distinct(),
        "both",
    )
    labels = loop.alternate(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("label")),
        "labels",
    )
    if labels.isEmpty():
        return labels
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("low")
        )
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        after = loop.alternate(
            lower.join(up, "low").select(
                "node", F.least("low", "up").alias("label"), (F.col("before") != F.least("low", "up")).alias("moved")
            ),
            "labels",
        )
        moved = not after.filter("moved").isEmpty()
        labels = after.select("node", "label")
        if not moved:
            return labels

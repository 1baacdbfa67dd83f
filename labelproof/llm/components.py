"""Connected components of an edge table by falling labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelproof.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the smallest node it is linked with.

    Each turn takes the smallest label among a node's neighbours, then the label of that label. Labels meet as
    partial minima, so a node with very many neighbours is no burden to one task.
    """
    both = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        "edges",
    )
    # a first turn without a join: the smallest of the node and its neighbours
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        beside = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        lowest = beside.groupBy("node").agg(F.min("label").alias("near"))
        fallen = labels.join(lowest, "node").select(
            "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(
            fallen.join(jump, "label", "left").select(
                "node",
                F.least("label", F.coalesce("further", "label")).alias("label"),
                (F.col("moved") | (F.coalesce(F.col("further"), F.col("label")) < F.col("label"))).alias("moved"),
            ),
            "labels",
        )
        labels = after.drop("moved")
        if after.filter("moved").isEmpty():
            return labels

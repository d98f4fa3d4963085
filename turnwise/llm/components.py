"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.sources.scratch import land, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of an edge (``u``, ``v``), of any orderable type.

    Each round, nodes take the least label among their neighbours, then the label of their label, so that labels jump over
    ever longer paths. Every round is written to the shared folder, and the loop ends when no label changes; the driver sees
    only that."""
    spark = edges.sparkSession
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = land(both, scratch_path(spark, "edges"))
    labels = land(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "node"), scratch_path(spark, "labels"))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = moved.select(F.col("node").alias("at"), F.col("root").alias("jumped"))
        after = moved.join(jump, F.col("root") == F.col("at"), "left").select("node", "was", F.least("root", F.coalesce("jumped", "root")).alias("root"))
        after = land(after, scratch_path(spark, "labels"))
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels

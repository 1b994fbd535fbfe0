"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.llm.tables import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), where root is the smallest node that can be reached.

    Each round gives a node the smallest root among its neighbours and then the root of that root, so a chain shortens by more than half a
    round. Rounds end when nothing moves. Neither edges nor labels pass through the driver, only the count of moves.
    """
    both = saved(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        jump = lower.join(labels.select(F.col("node").alias("to"), F.col("root").alias("beyond")), "to", "left")
        # the old root learns of the new one too, so whole trees move together
        told = lower.where("to < root").groupBy(F.col("root").alias("node")).agg(F.min("to").alias("told"))
        moved = jump.join(told, "node", "left").select("node", "root", F.least("to", "beyond", "told").alias("to"))
        moved = saved(moved)
        labels = moved.select("node", F.col("to").alias("root"))
        if moved.where("to < root").isEmpty():
            return labels

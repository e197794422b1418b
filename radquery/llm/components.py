"""Connected components by joins and aggregations of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radquery.llm.shared import write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't its component's smallest node, which is the root.

    Edges go from the greater to the smaller node. In each round a node keeps its smallest neighbour below and passes the
    others on to it; when no node has two, the edges are a forest, and paths are halved until each node points to its root.
    Joins read stored tables on both sides, so Spark can split the rows of a node that a great many others point to.
    """
    edges = edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).where("child != parent").distinct()
    while True:
        edges = write_table(edges, "edges")
        lowest = write_table(edges.groupBy("child").agg(F.min("parent").alias("lowest"), F.count("*").alias("n")), "lowest")
        if lowest.where("n > 1").isEmpty():
            break
        moved = edges.join(lowest.where("n > 1"), "child").where("parent != lowest").select(F.col("parent").alias("child"), F.col("lowest").alias("parent"))
        edges = lowest.select("child", F.col("lowest").alias("parent")).union(moved).distinct()
    forest = edges
    while True:
        above = forest.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        forest = write_table(forest.join(above, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "forest")
        if forest.where("moved").isEmpty():
            return forest.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        forest = forest.drop("moved")

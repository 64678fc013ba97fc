"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _roots(parents: DataFrame, rows: int) -> DataFrame:
    """node and root, for pointers (node, parent) with parent < node: pointers double in length until they all reach a root."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        joined = cut(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jump", rows)
        parents = joined.select("node", "parent")
        if joined.filter("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node of links (a, b) other than the roots themselves.

    Each node points at its smallest smaller neighbour; pointers are followed to their roots, links are rewritten between
    roots, and what remains is contracted again. Hubs are combined map-side, and their joins are ones that Spark can split.
    """
    every = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    rows = links.count()  # no later table has more rows
    edges, found = cut(every, "edges", rows), None
    while not edges.isEmpty():
        step = _roots(edges.groupBy("u").agg(F.min("v").alias("parent")).withColumnRenamed("u", "node"), rows)
        if found is None:
            found = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            moved = found.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
            found = cut(moved.unionByName(step), "roots", rows)
        left = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = edges.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
        edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows)
    if found is None:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return found

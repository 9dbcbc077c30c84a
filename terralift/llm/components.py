"""Connected components by alternating large-star and small-star steps; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralift.llm.common import materialize


def _mark(edges: DataFrame) -> tuple[int, object]:
    """Size of an edge set and an order-free hash of it."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def contracted(links: DataFrame) -> DataFrame:
    """``a, b``: the same components as ``links`` in fewer edges, where many links of a node lead to few smaller nodes.

    A node keeps its smallest neighbour, and its other smaller neighbours are linked to that one. Links are dealt by
    their larger node, so this is for links whose number for each larger node is bounded, as for forests by class.
    """
    lower = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    rows = lower.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return rows.select("a", F.col("m").alias("b")).union(rows.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (``a long, b long``): the root is the smallest node of the component.

    A hot node's neighbours are never gathered: both steps are a minimum by node (summed up in each task first) and a
    join that the engine can split. Self-loops and repeated edges are fine; nodes without an edge aren't returned.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _mark(links)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour is linked to the smallest node around
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: every smaller neighbour and the node itself are linked to the smallest
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import kept


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge upwards has that one only, to a node that has none."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(
        edges.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    counts = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    open_ends = counts.agg(F.max(F.expr("up > 1 or up = 1 and top = 1")).alias("any")).first()
    return not open_ends["any"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node with an edge.

    Edges go both ways; loops, repeated edges and edges with a null end change nothing (a node
    that has only such edges is left out). No edges give no rows. Each round links every node to
    its smallest neighbour, first upwards (large star), then downwards (small star), which needs
    a number of rounds that grows with the logarithm of the longest path. A node with a third of
    all edges is a plain join key: its minimum is aggregated before the shuffle, and the join
    can be split. Rounds are written to the shared folder; the driver sees whether one is the last.
    """
    x, y = F.col(a), F.col(b)
    now = kept(
        edges.where(x != y)
        .select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
    while not _stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        small = large.join(least, "hi").select(pairs.alias("e")).select("e.hi", "e.lo")
        now = kept(small.where("hi > lo").distinct(), "edges")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every node's larger (or smaller) neighbours, and itself, at the smallest
    node among them."""
    if large:
        both = edges.union(edges.select("v", "u"))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    pairs = both.join(low, "u")
    if large:
        out = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one type): root is the
    smallest node of its component.  Alternates large and small stars until the edges
    point at their roots; each round is written, and only whether it is the last reaches
    the driver."""
    a, b = edges.columns
    edges = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        # Done when every node points at one other, which itself points nowhere.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("goes"), F.lit(0).alias("comes")) \
            .union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("goes").alias("goes"), F.max("comes").alias("comes"))
        if ends.where("goes + comes > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .union(edges.select("v", "v").distinct())

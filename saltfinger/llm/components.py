"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .screen import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the least node of node's component.

    Large-star then small-star rounds, each a group-by and an equi-join, until
    every component is a star around its least node. Every round is cut at the
    shared checkpoint folder. Only nodes with an edge to another node appear; nulls
    and loops are ignored.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while not _stars(e):
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        e = cut(small)
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every edge goes from a node without other edges to a centre."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = e.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.out").alias("out"), F.max("x.into").alias("into"))
    return nodes.where("out > 1 OR out = 1 AND into = 1").isEmpty()

"""Connected components of an edge table by alternating star contraction.

Every step is a grouped minimum and an equi-join, so a hot vertex is combined before the shuffle and its edges can be
split. No link or label is ever sent to the driver; only the count of changed edges is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # a: centre, b: neighbour; in the small star every edge already points from the larger to the smaller end
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """True when every edge ends at a centre that is no one's neighbour, and no vertex has two centres."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    per = ends.groupBy("v").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return not per.where((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("high") > 0))).limit(1).count()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): every vertex of `edges` with the smallest id it is linked to, directly or not.

    Loops and repeated edges are ignored; a vertex without edges is not returned (it is its own component).
    """
    edges = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    edges = settle(edges)
    while not _stars(edges):
        edges = settle(_star(_star(edges, True), False))
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )

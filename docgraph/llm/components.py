"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MOST_ROUNDS = 60


def _hung(edges: DataFrame, larger: bool) -> DataFrame:
    """Hangs the neighbours of each node u (only the larger, or only the smaller and u itself) on the least of them and u."""
    if larger:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(least, "u")
    hung = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        hung = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for the nodes of ``edges`` (u, v).

    Neighbours meet by grouping and joining, never as a list, so a node with
    very many of them isn't gathered in one place.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "cc-edges")
    for _ in range(MOST_ROUNDS):
        if stars(edges):
            break
        edges = materialize(_hung(_hung(edges, True), False).distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def stars(edges: DataFrame) -> bool:
    """Whether every edge hangs a node on one smaller node that hangs on none: then nothing is left to do."""
    one = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"), (F.col("v") > F.col("u")).cast("int").alias("up"))
    two = edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"), F.lit(0).alias("up"))
    at = one.unionByName(two).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"), F.max("up").alias("up"))
    return not at.where("hangs > 1 OR (hangs > 0 AND holds > 0) OR up > 0").limit(1).count()

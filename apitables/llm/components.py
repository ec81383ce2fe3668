"""Connected components of a link relation, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apitables.session import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the least of them; links point to smaller nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two links to smaller nodes, or has one and is the smaller node of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return bool(sums.agg(F.max((F.col("down") > 1) | (F.col("down") * F.col("up") > 0))).first()[0])


def stars(links: DataFrame) -> DataFrame:
    """(u, v) for every node u of `links` (u, v) that is not the least of its class; v is that least node.

    A hot node is only ever met by sums with map-side combine and by joins that adaptive execution splits; no neighbour
    list is built. Links from a node to itself and null ends take no part.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unfinished(edges):
        edges = materialize(_small(_large(edges)))
    return edges


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of `links` (u, v); the class is its least node.

    Links from a node to itself give that node a class of its own; null ends take no part.
    """
    edges = stars(links)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    roots = edges.select(F.col("v").alias("node")).unionByName(links.where("u = v").select(F.col("u").alias("node"))).distinct()
    return found.unionByName(roots.join(found, "node", "left_anti").select("node", F.col("node").alias("class")))

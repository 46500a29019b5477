"""Connected components by alternating large-star and small-star steps on an edge table.

Each step is one grouping and one join; edges stay distributed and are written to the shared folder between rounds, so
lineage stays short. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node on an edge; the component is its least node. Loops and repeats do no harm."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    before = None
    while True:
        measure = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30)), F.sum(F.xxhash64("v", "u") % (1 << 30))).first()
        if before == measure:
            break
        before = measure
        now = written(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of the smaller ones."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return tied.where("u <> v").distinct()

"""Connected components of an edge table by alternating large and small stars.

Every round is a few grouped minima and joins on the edge table; nothing is collected but one row
of totals that tells when a round has changed nothing. A round's edges go to the checkpoint
folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = edges.join(least, "high").where("low > m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.unionByName(least.select("high", F.col("m").alias("low"))).distinct()


def _totals(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the component's least node.

    Edges may repeat and point either way; loops and edges with a null end are no edges. An empty
    table gives an empty result.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    edges = checkpointed(edges.distinct())
    seen = _totals(edges)
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _totals(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)

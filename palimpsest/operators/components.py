"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.workspace import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (columns ``u, v``, longs): the smallest node that can be reached.

    Each round hangs the larger neighbours of every node, then the smaller ones, on the smallest
    node known, until the edges are stars around the components' smallest nodes; that takes about the
    logarithm of the longest path. Edges stay in tables of the shared folder; a hub's
    edges can be split over tasks, as the other side of each join has a node once. Null ends and loops count for nothing.
    """
    edges = stored(
        spark,
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = _state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(nearest, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(spark, large.distinct(), "large-star")
        lowest = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(lowest, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(spark, small.union(lowest.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

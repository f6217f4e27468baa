"""Connected components of links, in rounds over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.sources.shared import kept


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``: root is the smallest node it reaches.

    Alternating large and small stars: each round ties every node's neighbours to its smallest
    neighbour, first those above it, then those below. Smallest neighbours are pre-aggregated, and
    a table is written per round, so a lost executor costs one round at most. The number of rounds
    grows with the logarithm of the number of nodes.
    """
    edges = kept(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    while True:
        both = _both(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m"))
        large = large.where("u <> m").select("u", F.col("m").alias("v")).distinct()
        below = _min_neighbour(large)
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(below.select("u", F.col("m").alias("v")))
        edges = kept(small.where("u <> v").distinct())
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(tops)

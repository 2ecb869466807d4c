"""Connected components by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.session import stored


def _tied(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) and the smallest neighbour of every u."""
    return edges, edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node it reaches.

    Minima are aggregated before they are shuffled and joined back, so a node
    with any number of links is never gathered. Every round is written to the
    shared folder; rounds end when the edge set no longer changes.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct(), "links")
    known = None
    while True:
        both, least = _tied(edges.union(edges.select("v", "u")))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down, least = _tied(large)
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = stored(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        known = state

"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()


def connected(edges: DataFrame, tag: str) -> DataFrame:
    """(u, label) for every vertex of edges (u, v): label is the smallest vertex of its component.

    Every round is written to the shared folder, which cuts lineage; the number of rounds grows with the logarithm of
    the longest path. Loops and repeated or reversed edges don't matter.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(edges, f"{tag}-edges"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before, edges = now, stored(_stars(edges), f"{tag}-edges")
    return edges.select("u", F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct())

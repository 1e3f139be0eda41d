"""Connected components by alternating large-star and small-star rounds; links stay in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the node's lowest neighbour (or the node)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "low").alias("low"))
    return both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each lower neighbour of a node, and the node, is linked to its lowest one (links run from u down to v)."""
    low = _lowest(links)
    moved = links.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum of the links, for the end of the rounds."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; component is the lowest node of its component.

    Loops, repeated links and either direction are fine; no links give an empty result.
    """
    up = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = common.materialize(links.filter(F.col(a) != F.col(b)).select(*up).distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = common.materialize(_small_star(_large_star(links)), "links")
        if (now := _mark(links)) == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _star(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Each row's ``v`` linked to the smallest node around its ``u``."""
    return (
        edges.join(lowest, "u")
        .where(F.col("v") != F.col("low"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
    )


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return _star(both.where("v > u"), lowest).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("low"))
    return _star(down, lowest).union(lowest.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link table (u, v); root is the smallest node reachable.

    Stars of large and of small neighbours alternate until nothing changes; each round works on
    at most as many rows as there are links, starts from written files, and sends two numbers to
    the driver. Links from a node to itself, repeated ones and null ends are harmless.
    """
    edges = saved(links.select("u", "v").where("u != v").distinct())
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(found)
        starred = saved(_large(edges))
        discard(edges)
        edges = saved(_small(starred))
        discard(starred)

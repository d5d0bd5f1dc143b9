"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is an aggregate (combined before rows move) and an equality join whose two sides are dealt anew, so that
the rows of a node with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, removed, stored


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of each u and its neighbours."""
    return dealt_anew(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, label of every node that has a link: label is the least node that can be reached.

    ``links`` has two columns of integers; direction, repeats and self-links do not matter. No links: no rows.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    state = None
    while (now := _state(edges)) != state:
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        small = large.join(_least(large), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, stored(small.where("u <> v").distinct(), "small-star")
        removed(old, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

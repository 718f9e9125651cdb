"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node it is connected with) of every node of the links.

    Each step links the neighbours of every node to its least neighbour. Steps are written to the shared folder, and end
    when a step changes nothing; their number grows with the logarithm of the longest path. A node with very many links
    is a skewed join key only, never a collected group.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    edges = stored(edges, "links")
    state = None
    while True:
        large = _star(edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v"))), larger=True)
        small = _star(large.select(F.col("high").alias("u"), F.col("low").alias("v")), larger=False)
        edges = stored(small, "links")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """high, low: for each u, its neighbours v (the larger ones only, or all and u itself) linked to its least neighbour."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("m", "u").alias("m"))
    joined = directed.join(least, directed["u"] == least["of"])
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:
        out = joined.select(F.col("v").alias("high"), F.col("m").alias("low")).unionByName(least.select(F.col("of").alias("high"), F.col("m").alias("low")))
    return out.where(F.col("high") != F.col("low")).distinct()

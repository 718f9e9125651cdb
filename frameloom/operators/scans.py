"""Ordered scans of streams of any size: ranges of the sorted rows, and the rows at their edges handed from range to range.

A window by stream puts a stream into one task. Here rows are dealt out by ranges of (keys, order), so that a large stream
lies in many ranges; what a row needs of rows before its range comes from the edges of ranges alone, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """rows sorted by keys and order in ranges, with the range as __range. The number of ranges is fixed, so that all that
    is made from them sees the same ones."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__range", F.spark_partition_id())


def lagged(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: dict[str, tuple[str, int]], parts: int | None = None) -> DataFrame:
    """rows with, under each name of values, the column's value that many rows before (after, if negative) within the keys.

    The first and last rows of each key in a range, as many as the farthest look, are its edges. All other rows find what
    they need in their range; edges find it among the edges of their key, a few rows a range.
    """
    far = max(abs(k) for _, k in values.values())
    w = Window.partitionBy("__range", *keys).orderBy(*order)
    look = lambda over: [F.lag(c, k).over(over).alias(name) if k > 0 else F.lead(c, -k).over(over).alias(name) for name, (c, k) in values.items()]
    r = ranged(rows, keys, order, parts).select("*", F.row_number().over(w).alias("__from_start"), F.count("*").over(Window.partitionBy("__range", *keys)).alias("__n"))
    edge = (F.col("__from_start") <= far) | (F.col("__n") - F.col("__from_start") < far)
    # the rows next to edges are needed by them, so edges are twice as deep as what is taken from them
    deep = (F.col("__from_start") <= 2 * far) | (F.col("__n") - F.col("__from_start") < 2 * far)
    inner = r.select("*", *look(w)).where(~edge)
    edges = r.where(deep).select("*", *look(Window.partitionBy(*keys).orderBy("__range", *order))).where(edge)
    return inner.unionByName(edges).select(*rows.columns, *values)


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str, parts: int | None = None) -> DataFrame:
    """rows with their number, from 1, within the keys: counted in their range, plus the rows of ranges before."""
    r = ranged(rows, keys, order, parts)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = r.groupBy(*keys, "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = r.withColumn(name, F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)))
    return here.join(counts, [*keys, "__range"]).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).select(*rows.columns, name)


def top_n(rows: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...], n: int, by: tuple[str, ...], deals: int = 64) -> DataFrame:
    """The first n rows of each key in that order, in two phases: rows of a key are dealt out by a hash of `by`, each share
    keeps n, and what is left of a key, deals * n rows at most, is ranked once more (column rank)."""
    share = rows.withColumn("__share", F.pmod(F.xxhash64(*by), F.lit(deals)))
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "__share").orderBy(*order))).where(F.col("rank") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n).drop("__share")

"""Masks as run tables: rows (page_id, y, x_start, x_end), half-open, with further key columns where a page has several masks.

Set operations are a sweep over the ends of runs in each row of a page: ends are summed by place, running sums over a window say which
masks hold at each stretch, and stretches that touch are joined. No pixel is ever made; a row of a page meets in one task, its neighbours need not.

Cases: empty runs (x_end <= x_start) and null places count as no run; repeated and overlapping runs of a mask count once; an empty mask
is an empty table; runs of a result touch nowhere, so a result has one form only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ("page_id",)


def merged(runs: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Each mask with its overlapping and touching runs joined."""
    row = W.partitionBy(*keys, "y").orderBy("x_start", "x_end")
    before = F.max("x_end").over(row.rowsBetween(W.unboundedPreceding, -1))
    cut = runs.where("x_end > x_start AND y IS NOT NULL").select(*keys, "y", "x_start", "x_end")
    cut = cut.withColumn("new", F.when(before >= F.col("x_start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(row))
    return cut.groupBy(*keys, "y", "island").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")).drop("island")


def combined(a: DataFrame, b: DataFrame, rule: Callable[[Column, Column], Column], keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The mask of the places where rule(in a, in b) holds; the rule must be false where neither mask is."""
    ends = None
    for runs, left, right in ((a, 1, 0), (b, 0, 1)):
        runs = runs.where("x_end > x_start AND y IS NOT NULL")
        for x, sign in (("x_start", 1), ("x_end", -1)):
            part = runs.select(*keys, "y", F.col(x).alias("x"), F.lit(sign * left).alias("a"), F.lit(sign * right).alias("b"))
            ends = part if ends is None else ends.unionByName(part)
    ends = ends.groupBy(*keys, "y", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = W.partitionBy(*keys, "y").orderBy("x")
    held = ends.select(*keys, "y", F.col("x").alias("x_start"), F.lead("x").over(row).alias("x_end"), (F.sum("a").over(row) > 0).alias("a"), (F.sum("b").over(row) > 0).alias("b"))
    return merged(held.where(F.col("x_end").isNotNull() & rule(F.col("a"), F.col("b"))), keys)


def union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    return merged(a.select(*keys, "y", "x_start", "x_end").unionByName(b.select(*keys, "y", "x_start", "x_end")), keys)


def intersection(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    return combined(a, b, lambda x, y: x & y, keys)


def difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    return combined(a, b, lambda x, y: x & ~y, keys)


def whole(sizes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The full mask of each page (keys, w, h)."""
    return sizes.where("w > 0 AND h > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)).alias("y"), F.lit(0).alias("x_start"), F.col("w").cast("int").alias("x_end"))


def complement(a: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """What a page has beside the mask; a page without a run is full."""
    return difference(whole(sizes, keys), a, keys)


def rectangles(boxes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Boxes (keys, x1, y1, x2, y2) as masks."""
    rows = F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y")
    return boxes.where("x2 > x1 AND y2 > y1").select(*keys, rows, F.col("x1").alias("x_start"), F.col("x2").alias("x_end"))


def measures(runs: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, n, x1, y1, x2, y2): pixels and bounds of each mask whose runs do not overlap."""
    return runs.groupBy(*keys).agg(F.sum((F.col("x_end") - F.col("x_start")).cast("long")).alias("n"), F.min("x_start").alias("x1"), F.min("y").alias("y1"), F.max("x_end").alias("x2"), (F.max("y") + 1).alias("y2"))

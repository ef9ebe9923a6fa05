"""Greedy and keyed de-duplication of boxes within pages.

Each page is one group (its boxes are few and come from one image), folded inside the JVM; pages spread over the
cluster by page_id, and one exchange serves all steps on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def _greedy(boxes: DataFrame, order: list[Column], clash) -> DataFrame:
    """Rows that no earlier kept row of their page clashes with."""
    row = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("region_id"), G.of().alias("box"))
    pages = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    none = F.filter("rows", lambda r: F.lit(False))
    kept = F.aggregate("rows", none, lambda acc, r: F.when(F.exists(acc, lambda k: clash(k["box"], r["box"])), acc).otherwise(F.concat(acc, F.array(r))))
    return pages.select("page_id", F.explode(F.transform(kept, lambda k: k["region_id"])).alias("region_id"))


def nms(boxes: DataFrame, limit: float = 0.45) -> DataFrame:
    """Non-maximum suppression: best score first, ties to the smaller id; what overlaps a kept box by IoU > limit goes."""
    return _greedy(boxes, [-F.col("score")], lambda k, b: G.iou(k, b) > limit)


def overlap_dedupe(boxes: DataFrame, limit: float = 0.72) -> DataFrame:
    """In order of arrival: a box that an earlier one covers by more than limit (of the smaller area) goes."""
    return _greedy(boxes, [], lambda k, b: G.overlap(k, b) > limit)


def quantised_dedupe(boxes: DataFrame, text: str, cell: int) -> DataFrame:
    """The first row of each text and place, places rounded down to cells."""
    key = [F.col("page_id"), F.col(text), *[F.floor(F.col(c) / cell) for c in ("x1", "y1", "x2", "y2")]]
    first = F.row_number().over(W.partitionBy(*key).orderBy("region_id"))
    return boxes.withColumn("__n", first).where("__n = 1").drop("__n")


def renumbered(boxes: DataFrame) -> DataFrame:
    """item_id: dense numbers from 0 in reading order."""
    return boxes.withColumn("item_id", F.row_number().over(W.partitionBy("page_id").orderBy("y1", "x1", "region_id")) - 1)

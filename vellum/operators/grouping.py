"""Lines into clusters, columns into groups, over-wide groups into chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def line_clusters(boxes: DataFrame) -> DataFrame:
    """cluster: number of the run of lines, in reading order, in which each continues the one before."""
    page = W.partitionBy("page_id")
    unit = F.greatest(F.lit(10.0), F.median(F.col("y2") - F.col("y1")).over(page) * 0.75)
    df = boxes.withColumn("band", F.bround(F.col("y1") / unit, 0)).withColumn("box", G.of())
    order = page.orderBy("band", "x1", "region_id")
    df = df.withColumn("before", F.lag("box").over(order))
    new = F.when(F.col("before").isNull() | ~G.line_link(F.col("before"), F.col("box")), 1).otherwise(0)
    return df.withColumn("new", new).withColumn("cluster", F.sum("new").over(order).cast("int") - 1).drop("band", "before", "new", "box")


def cluster_items(clusters: DataFrame) -> DataFrame:
    """A cluster's union box, number of lines, and confidence weighted by text length."""
    weight = F.greatest(F.lit(1), F.col("txt_len"))
    return clusters.groupBy("page_id", "cluster").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_lines"), (F.sum(F.col("score") * weight) / F.sum(weight)).alias("confidence"))


def vertical_groups(boxes: DataFrame) -> DataFrame:
    """group_id: smallest id of the boxes that are linked as columns of one text, over any number of links."""
    row = F.struct("region_id", G.of().alias("box"), "img_w", "img_h")
    pages = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    none = F.filter(F.array("rows"), lambda g: F.lit(False))

    def add(groups, r):
        linked = lambda g: F.exists(g, lambda m: G.vertical_link(m["box"], r["box"], r["img_w"], r["img_h"]))
        one = F.concat(F.flatten(F.filter(groups, linked)), F.array(r))
        return F.concat(F.filter(groups, lambda g: ~linked(g)), F.array(one))

    groups = pages.select("page_id", F.explode(F.aggregate("rows", none, add)).alias("g"))
    return groups.select("page_id", F.array_min(F.transform("g", lambda m: m["region_id"])).alias("group_id"), F.explode(F.transform("g", lambda m: m["region_id"])).alias("region_id"))


def overwide_chunks(grouped: DataFrame) -> DataFrame:
    """chunk: groups of four columns and more that are far wider than their columns are cut into twos or threes,
    from left to right; a last single one joins the chunk before."""
    own = W.partitionBy("page_id", "group_id")
    df = grouped.withColumn("box", G.of())
    tall = F.when(G.page_column(F.col("box"), F.col("img_h")), G.width(F.col("box")))
    df = df.withColumns({"n": F.count(F.lit(1)).over(own), "widths": F.sort_array(F.collect_list(tall).over(own)), "wide": F.max("x2").over(own) - F.min("x1").over(own), "at": F.row_number().over(own.orderBy("x1", "region_id")) - 1})
    middle = F.element_at("widths", (F.floor(F.size("widths") / 2) + 1).cast("int"))
    limit = F.greatest(F.lit(90), (F.col("img_w") * 0.11).cast("int"), (middle * 2.9).cast("int"))
    cut = (F.col("n") >= 4) & (F.size("widths") >= 4) & (F.col("wide") > limit)
    size = F.when(F.col("n") <= 5, 2).otherwise(3)
    chunk = F.floor(F.col("at") / size)
    lone = (F.col("n") % size == 1) & (F.col("at") == F.col("n") - 1)
    return df.select("page_id", "group_id", "region_id", F.when(F.when(F.col("n") >= 4, cut).otherwise(False), F.when(lone, chunk - 1).otherwise(chunk)).otherwise(0).cast("int").alias("chunk"))


def _joint(boxes: np.ndarray, one: np.ndarray, gap: int, share: float) -> np.ndarray:
    """Which of the boxes stand beside one of them: nearer than gap across, and sharing rows of the lower of the two."""
    low, high = np.maximum(boxes[:, :2], one[:2]), np.minimum(boxes[:, 2:], one[2:])
    height = np.minimum(boxes[:, 3] - boxes[:, 1], one[3] - one[1])
    return (low[:, 0] - high[:, 0] < gap) & (np.maximum(0, high[:, 1] - low[:, 1]) > share * height)


def merge_boxes(boxes: list[list[int]], gap: int = 25, share: float = 0.3) -> list[list[int]]:
    """Boxes side by side grow together until no two are joint; the first joint pair, by the first box and then the second, goes
    first each time, and the second box of a pair is taken into the first.

    Boxes before `focus` are joint with none. When a box has grown only its own pairs are new, so its first neighbour
    before it takes it in and becomes the focus, else it takes in its first neighbour after it."""
    left, focus = np.array(boxes, np.int64).reshape(-1, 4), 0
    while focus < len(left):
        near = np.flatnonzero(_joint(left, left[focus], gap, share))
        near = near[near != focus]
        if not len(near):
            focus += 1
            continue
        first, second = sorted((focus, int(near[0])))
        left[first] = *np.minimum(left[first, :2], left[second, :2]), *np.maximum(left[first, 2:], left[second, 2:])
        left, focus = np.delete(left, second, axis=0), first
    return left.tolist()


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """merge_boxes() for each page. The result depends on the order of joins, so a page is folded in one piece: its boxes
    become one array in the JVM, and many pages cross to Python in one Arrow batch."""
    row = F.struct("region_id", "x1", "y1", "x2", "y2")
    pages = boxes.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"])).alias("boxes"))

    def merge(batches):
        for batch in batches:
            merged = [merge_boxes(b) for b in batch.column("boxes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(merged, pa.list_(pa.list_(pa.int32())))], names=["page_id", "boxes"])

    found = pages.mapInArrow(merge, "page_id long, boxes array<array<int>>").select("page_id", F.posexplode("boxes").alias("box_id", "b"))
    return found.select("page_id", "box_id", *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def combined_crops(lines: DataFrame, least: float = 0.35) -> DataFrame:
    """Text and weighted confidence of the lines of a crop (page_id, group_id, text, score, x, y, h), in reading order."""
    kept = lines.where((F.col("score") >= least) & (F.trim("text") != ""))
    place = F.struct(F.bround(F.col("y") / F.greatest(F.lit(8.0), F.col("h") * 0.7), 0).alias("band"), F.col("x").alias("x"), F.col("region_id").alias("region_id"), F.trim("text").alias("text"))
    weight = F.greatest(F.lit(1), F.length(F.trim("text")))
    own = kept.groupBy("page_id", "group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda r: r["text"]), " ").alias("text"), (F.sum(F.col("score") * weight) / F.sum(weight)).alias("confidence"))
    every = lines.select("page_id", "group_id").distinct()
    return every.join(own, ["page_id", "group_id"], "left").select("page_id", "group_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))

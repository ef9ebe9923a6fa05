"""Boxes and bubbles. All joins are on page_id with a geometric residual, so none is a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def pairs(boxes: DataFrame, measure, name: str) -> DataFrame:
    """Pairs of boxes of a page, smaller id first, whose measure is above 0."""
    a = boxes.select("page_id", F.col("region_id").alias("a"), G.of().alias("abox"))
    b = boxes.select("page_id", F.col("region_id").alias("b"), G.of().alias("bbox"))
    met = a.join(b, "page_id").where((F.col("a") < F.col("b")) & (G.intersection(F.col("abox"), F.col("bbox")) > 0))
    return met.select("page_id", "a", "b", measure(F.col("abox"), F.col("bbox")).alias(name))


def _inside(boxes: DataFrame, bubbles: DataFrame) -> DataFrame:
    b = bubbles.select("page_id", "bubble_id", G.of().alias("bubble"))
    met = boxes.withColumn("box", G.of()).join(b, "page_id")
    return met.withColumn("share", G.intersection(F.col("box"), F.col("bubble")) / F.greatest(F.lit(1), G.area(F.col("box"))))


def best_bubble(boxes: DataFrame, bubbles: DataFrame, floor: float = 0.18) -> DataFrame:
    """bubble_idx: the bubble that covers most of a box, at least `floor` of it (ties to the smaller id), else -1."""
    pages = bubbles.groupBy("page_id").agg(F.collect_list(F.struct("bubble_id", G.of().alias("b"))).alias("__bubbles"))
    share = lambda b: G.intersection(G.of(), b) / F.greatest(F.lit(1), G.area(G.of()))
    shares = F.transform("__bubbles", lambda x: F.struct(share(x["b"]).alias("share"), (-x["bubble_id"]).alias("minus")))
    best = F.array_max(F.filter(shares, lambda x: x["share"] >= floor))
    return boxes.join(pages, "page_id", "left").withColumn("bubble_idx", F.coalesce(-best["minus"], F.lit(-1))).drop("__bubbles")


def first_bubble(boxes: DataFrame, bubbles: DataFrame, above: float = 0.4) -> DataFrame:
    """Boxes with the first bubble that covers more than `above` of them."""
    return _inside(boxes, bubbles).where(F.col("share") > above).groupBy("page_id", "region_id").agg(F.min("bubble_id").alias("bubble_id"))


def uncovered(candidates: DataFrame, routed: DataFrame, limit: float = 0.3, least_area: int = 100) -> DataFrame:
    """Candidates that no routed box of the page overlaps by more than limit."""
    r = routed.select(F.col("page_id").alias("rpage"), G.of().alias("rbox"))
    c = candidates.withColumn("box", G.of()).where(G.area(F.col("box")) >= least_area)
    return c.join(r, (F.col("page_id") == F.col("rpage")) & (G.overlap(F.col("box"), F.col("rbox")) > limit), "left_anti").drop("box")


def unrouted(bubbles: DataFrame, routed: DataFrame) -> DataFrame:
    """Bubbles without a routed box."""
    taken = routed.select("page_id", F.col("bubble_idx").alias("bubble_id")).where("bubble_id >= 0")
    return bubbles.join(taken, ["page_id", "bubble_id"], "left_anti")


def modal_route(clusters: DataFrame, routed: DataFrame) -> DataFrame:
    """The commonest route (ties to the first in the alphabet) and highest score of the boxes that a cluster meets."""
    r = routed.select("page_id", "route", "score", G.of().alias("rbox"))
    met = clusters.withColumn("box", G.of()).join(r, "page_id").where(G.intersection(F.col("box"), F.col("rbox")) > 0)
    by = met.groupBy("page_id", "cluster", "route").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    found = by.groupBy("page_id", "cluster").agg(F.min(F.struct(-F.col("n"), F.col("route"))).getField("route").alias("route"), F.max("top").alias("top"))
    return clusters.select("page_id", "cluster").join(found, ["page_id", "cluster"], "left").select("page_id", "cluster", F.coalesce("route", F.lit("bubble_dialogue")).alias("route"), F.coalesce("top", F.lit(0.0)).alias("confidence"))

"""Decisions around text removal: which boxes to clean, and whether a region's statistics allow it. The pixel writes are
kernels elsewhere; what is decided here is expressions over columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def cleanup_box(red: Column, green: Column, w: Column, h: Column) -> Column:
    """The text's box; for tall narrow text with its layout box, if that is not far larger."""
    rw, rh = red["x2"] - red["x1"], red["y2"] - red["y1"]
    tall = (rh >= rw * 1.35) & (rw <= F.greatest(F.lit(180), (w * 0.16).cast("int"))) & (F.greatest(F.lit(1), G.area(green)) <= F.greatest(F.lit(1), G.area(red)) * 2.4)
    both = G.clamp(F.least(red["x1"], green["x1"]), F.least(red["y1"], green["y1"]), F.greatest(red["x2"], green["x2"]), F.greatest(red["y2"], green["y2"]), w, h)
    return F.when(tall, both).otherwise(G.box(red["x1"], red["y1"], red["x2"], red["y2"]))


def erase_boxes(main: Column, more: Column, w: Column, h: Column) -> Column:
    """The main box and the explicit ones, a pixel wider, on the page, without those inside the main one; none if there are no
    explicit ones."""
    grown = F.filter(F.transform(F.concat(F.array(main), more), lambda b: G.box(*[F.greatest(F.lit(0), F.least(m, b[k] + d)) for k, m, d in (("x1", w, -1), ("y1", h, -1), ("x2", w, 1), ("y2", h, 1))])), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    first = F.try_element_at(grown, F.lit(1))
    inside = lambda b: (b["x1"] >= first["x1"] - 2) & (b["y1"] >= first["y1"] - 2) & (b["x2"] <= first["x2"] + 2) & (b["y2"] <= first["y2"] + 2)
    kept = F.when(F.size(grown) > 1, F.concat(F.slice(grown, 1, 1), F.filter(F.slice(grown, F.lit(2), F.size(grown)), lambda b: ~inside(b)))).otherwise(grown)
    return F.when(F.size(more) == 0, F.slice(grown, 1, 0)).otherwise(kept)


def overlay_box(green: Column, red: Column, w: Column, h: Column) -> Column:
    """Room for a replacement plate around both boxes."""
    wide, high = F.greatest(G.width(green), G.width(red)), F.greatest(G.height(green), G.height(red))
    dx = F.least(F.greatest(F.lit(28), (wide * 0.32).cast("int")), (w * 0.16).cast("int"))
    dy = F.least(F.greatest(F.lit(16), (high * 0.16).cast("int")), (h * 0.08).cast("int"))
    return G.coerced(G.box(F.least(green["x1"], red["x1"]) - dx, F.least(green["y1"], red["y1"]) - dy, F.greatest(green["x2"], red["x2"]) + dx, F.greatest(green["y2"], red["y2"]) + dy), w, h)


def unsafe(paper: Column, dark: Column, edges: Column, near_edges: Column, open_edges: Column, open_dark: Column, spread: Column) -> Column:
    """Whether to leave a floating text alone: its surroundings are neither flat paper, nor flat dark, nor a flat light tone."""
    white = (paper >= 0.86) & (near_edges <= 0.035) & (open_dark <= 0.055) & (edges <= 0.16)
    black = (dark >= 0.72) & (near_edges <= 0.045) & (open_edges <= 0.060) & (spread <= 32.0)
    tone = (paper >= 0.72) & (near_edges <= 0.025) & (open_dark <= 0.040) & (edges <= 0.075) & (spread <= 18.0)
    return ~(white | black | tone)


def text_style(median: Column, p75: Column, dark: Column, median_limit: float = 90.0, p75_limit: float = 130.0) -> Column:
    """Light text on dark ground, else dark on light (also where nothing is known)."""
    return F.when(((median < median_limit) & (p75 < p75_limit)) | (dark >= 0.38), "light_on_dark").otherwise("dark_on_light")


def row_band(rows: DataFrame, key: str, row: str, value: str, reach: int) -> DataFrame:
    """band: the median of the values within `reach` rows."""
    near = W.partitionBy(key).orderBy(row).rangeBetween(-reach, reach)
    return rows.withColumn("band", F.expr(f"percentile({value}, 0.5)").over(near))


def carried(rows: DataFrame, key: str, row: str, value: str) -> DataFrame:
    """carried: the last value that is known at or before a row."""
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(row).rowsBetween(W.unboundedPreceding, 0)))

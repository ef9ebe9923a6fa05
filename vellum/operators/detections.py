"""What detectors and readers return, as boxes and lines that later steps can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .dedupe import quantised_dedupe
from .routing import best_bubble


def detector_boxes(found: DataFrame, least: float = 0.05, side: int = 1024) -> DataFrame:
    """(page_id, region_id, x1, y1, x2, y2, score): detections (cx, cy, w, h, score in a square of `side`) scored above `least`, on
    their page and cut to it; those without area go."""
    sx, sy = F.col("img_w") / F.lit(float(side)), F.col("img_h") / F.lit(float(side))
    ends = [((F.col(c) + sign * F.col(size) / 2) * scale) for sign in (-1, 1) for c, size, scale in (("cx", "w", sx), ("cy", "h", sy))]
    cut = G.box(F.greatest(F.lit(0.0), ends[0]), F.greatest(F.lit(0.0), ends[1]), F.least(F.col("img_w").cast("double"), ends[2]), F.least(F.col("img_h").cast("double"), ends[3]))
    boxes = found.where(F.col("score") > least).select("page_id", "region_id", cut.alias("b"), "score")
    return boxes.select("page_id", "region_id", "b.*", "score").where("x2 > x1 and y2 > y1")


def valid_bubbles(pixels: DataFrame, *mask: str) -> DataFrame:
    """(mask, n, white, mean): masks (one row a pixel: mask, x, y, gray) that look like a bubble: large enough, white enough, not a
    thin column, and bright on the mean. Sums and bounds combine before the shuffle."""
    masks = pixels.groupBy(*mask).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("gray") > 200).cast("int")).alias("white"), F.avg("gray").alias("mean"),
        (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
    )
    thin = (F.col("h") > F.col("w") * 2.5) & (F.col("n") < 5000)
    return masks.where((F.col("n") >= 200) & (F.col("white") >= 0.7) & ~thin & (F.col("mean") >= 180)).drop("w", "h")


def han_lines(lines: DataFrame) -> DataFrame:
    """Lines read well enough that hold a Han character, 3 pixels larger, first of those with one text and place."""
    own = lines.withColumn("text", T.strip(F.col("text"))).where((F.col("score") >= 0.42) & (T.count(F.col("text"), T.HAN) > 0))
    grown = own.withColumn("b", G.expanded(G.of(), F.lit(3), F.lit(3), F.col("img_w"), F.col("img_h")))
    fits = grown.where((G.width(F.col("b")) >= 6) & (G.height(F.col("b")) >= 6) & (G.area(F.col("b")) >= 45))
    return quantised_dedupe(fits.withColumns({c: F.col("b")[c] for c in ("x1", "y1", "x2", "y2")}).drop("b"), "text", 5)


def korean_lines(lines: DataFrame) -> DataFrame:
    """Lines that one of two reading passes (pass: ko or ch) may keep, 4 pixels larger: enough characters of its script at its
    score, or in pass ko a single one at a score of 0.08."""
    t = T.strip(F.col("text"))
    hangul, han = T.count(t, T.HANGUL_WIDE), T.count(t, T.HAN)
    ko = ((hangul >= 2) & (F.col("score") >= 0.5)) | ((hangul == 1) & (F.col("score") >= 0.08))
    kept = lines.where(F.when(F.col("pass") == "ko", ko).when(F.col("pass") == "ch", (han >= 2) & (F.col("score") >= 0.65)))
    grown = kept.withColumns({"text": t, "b": G.expanded(G.of(), F.lit(4), F.lit(4), F.col("img_w"), F.col("img_h"))})
    return grown.where((G.width(F.col("b")) >= 8) & (G.height(F.col("b")) >= 8)).withColumns({c: F.col("b")[c] for c in ("x1", "y1", "x2", "y2")}).drop("b")


def usable_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that are large enough to be read."""
    return boxes.where((G.area(G.of()) >= 80) & (G.width(G.of()) >= 5) & (G.height(G.of()) >= 5))


def raw_unions(boxes: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(page_id, bubble_idx, route, mask_mode, x1, y1, x2, y2): where a page's text goes if no line was read: inside the bubble that
    holds the union of its usable boxes, else inside the page, each less a margin."""
    lo = lambda c: F.greatest(F.lit(0), F.min(c) - 14).alias(c)
    hi = lambda c, most: F.least(F.max(most), F.max(c) + 14).alias(c)
    union = usable_boxes(boxes).groupBy("page_id").agg(F.lit(0).alias("region_id"), lo("x1"), lo("y1"), hi("x2", "img_w"), hi("y2", "img_h"), F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"))
    placed = best_bubble(union, bubbles).drop("x1", "y1", "x2", "y2")
    held = placed.join(bubbles.select("page_id", F.col("bubble_id").alias("bubble_idx"), G.of().alias("b")), ["page_id", "bubble_idx"], "left")
    part = lambda size, least, share: F.greatest(F.lit(least), (size * F.lit(share)).cast("int"))
    w, h = F.col("img_w"), F.col("img_h")
    dx, dy = part(F.col("b.x2") - F.col("b.x1"), 2, 0.04), part(F.col("b.y2") - F.col("b.y1"), 2, 0.04)
    inside = G.expanded(F.col("b"), -dx, -dy, w, h)
    mx, my = part(w, 4, 0.03), part(h, 4, 0.03)
    found = F.col("bubble_idx") >= 0
    area = F.when(found, inside).otherwise(G.box(mx, my, w - mx, h - my))
    kind = lambda yes, no: F.when(found, yes).otherwise(no)
    return held.select("page_id", "bubble_idx", kind("bubble_dialogue", "floating_dialogue").alias("route"), kind("bubble_interior", "stroke").alias("mask_mode"), area.alias("a")).select("page_id", "bubble_idx", "route", "mask_mode", "a.*")


def green_box(red: Column, green: Column, bubble: Column) -> Column:
    """The layout box holds at least its text box, half a percent larger, and stays 5 % inside its bubble (null: none)."""
    dx, dy = (F.greatest(F.lit(1.0), size * F.lit(0.005)) for size in (G.width(red), G.height(red)))
    cut = lambda c: c.cast("int")
    wide = [F.least(green["x1"], cut(red["x1"] - dx)), F.least(green["y1"], cut(red["y1"] - dy)), F.greatest(green["x2"], cut(red["x2"] + dx)), F.greatest(green["y2"], cut(red["y2"] + dy))]
    mx, my = (F.greatest(F.lit(1), cut(size * F.lit(0.05))) for size in (bubble["x2"] - bubble["x1"], bubble["y2"] - bubble["y1"]))
    # greatest and least pass nulls over: without a bubble the box stays as it is
    return G.box(F.greatest(wide[0], bubble["x1"] + mx), F.greatest(wide[1], bubble["y1"] + my), F.least(wide[2], bubble["x2"] - mx), F.least(wide[3], bubble["y2"] - my))


def within(points: Column, b: Column) -> Column:
    """An outline's points moved into the box, if it has three and more."""
    moved = F.transform(points, lambda p: F.struct(F.greatest(b["x1"], F.least(b["x2"], p["x"])).alias("x"), F.greatest(b["y1"], F.least(b["y2"], p["y"])).alias("y")))
    return F.when(F.size(points) >= 3, moved).otherwise(points)


def repair_box(base: Column, extra: Column, w: Column, h: Column) -> Column:
    """The union of both boxes (extra may be null), each end on the page."""
    on = lambda c, most: F.greatest(F.lit(0), F.least(most, c))
    return G.box(on(F.least(base["x1"], extra["x1"]), w), on(F.least(base["y1"], extra["y1"]), h), on(F.greatest(base["x2"], extra["x2"]), w), on(F.greatest(base["y2"], extra["y2"]), h))


def repair_pad(b: Column) -> Column:
    """Margin around a caption that is repaired: 6 pixels for compact ones, else 2."""
    return F.when((G.width(b) <= 180) & (G.height(b) <= 120), 6).otherwise(2)


def shown_box(b: Column, sx: Column, sy: Column, w: Column, h: Column) -> Column:
    """A box of a resized page on the page itself, 2 pixels larger; null if it is under 8 pixels wide or high."""
    out = G.clamp(F.floor(b["x1"] * sx) - 2, F.floor(b["y1"] * sy) - 2, F.ceil(b["x2"] * sx) + 2, F.ceil(b["y2"] * sy) + 2, w, h)
    return F.when((out["x2"] - out["x1"] >= 8) & (out["y2"] - out["y1"] >= 8), out)


def snapshot_crop(left: Column, top: Column, width: Column, height: Column, zoom: Column, ratio: Column) -> Column:
    """An element's rectangle in the pixels of a screenshot, at least one wide and high; halves round up."""
    at = lambda c, least: F.greatest(F.lit(least), F.floor(F.coalesce(c, F.lit(0)) * zoom * F.coalesce(F.nullif(ratio, F.lit(0.0)), F.lit(1.0)) + 0.5).cast("int"))
    return F.struct(at(left, 0).alias("x"), at(top, 0).alias("y"), at(width, 1).alias("w"), at(height, 1).alias("h"))


def with_translation(layout: DataFrame, answers: DataFrame) -> DataFrame:
    """Layout items whose answer (page_id, region_id, en_text) can be shown."""
    return layout.join(answers.where(T.renderable(F.col("en_text"))).select("page_id", "region_id"), ["page_id", "region_id"], "left_semi")


def with_cleanup(layout: DataFrame, status: DataFrame) -> DataFrame:
    """(…, cleanup, reason): draw, badge, cover or skip, by the status (page_id, region_id, cleaned, reason) of items outside bubbles.
    Items without a status, and those in bubbles, are drawn."""
    own = status.select("page_id", "region_id", "cleaned", F.col("reason").alias("__reason"))
    unclean = (F.col("bubble_idx") == -1) & ~F.coalesce("cleaned", F.lit(True))
    reason = F.when(unclean, F.coalesce("__reason", F.lit("unsafe_art_preserved")))
    found = layout.join(own, ["page_id", "region_id"], "left").withColumn("reason", reason)
    kind = F.when(F.col("reason").isNull(), "draw").when(F.col("reason") == "device_overlay_required", "badge").when(F.col("reason") == "source_cover_required", "cover").otherwise("skip")
    return found.withColumn("cleanup", kind).drop("cleaned", "__reason")


def sample_language(name: Column) -> Column:
    """The reader's language by a sample's name; null where the name tells none."""
    low = F.lower(name)
    named = lambda code: F.contains(low, F.lit(f"_{code}_")) | low.rlike(f"^(external|modern|runtime)_{code}")
    return F.when(named("zh"), "ch_tra").when(named("ko"), "ko")


def without_placeholder(c: Column) -> Column:
    """A placeholder's text up to its dots; other texts as they are."""
    bare = F.replace(F.replace(c, F.lit("[TL: "), F.lit("")), F.lit("]"), F.lit(""))
    return F.when(F.startswith(c, F.lit("[TL:")), F.substring_index(bare, "...", 1)).otherwise(c)


def cents(x: Column) -> Column:
    """Two decimals, halves away from zero, of the number's first 15 digits."""
    return F.floor(F.format_string("%.14e", F.abs(x) * 100).cast("double") + 0.5) / 100 * F.signum(x)


def access_blocked(statuses: Column) -> Column:
    """Whether there are answers and all of them refuse access."""
    return (F.size(statuses) > 0) & F.forall(statuses, lambda s: s.isin(401, 403))


def restored(entries: DataFrame, cache: str, used: str, place: str, result: str) -> DataFrame:
    """(…, age): the entries of each cache that hold a result, oldest first from 1; equal times, and none (0), keep the order of
    `place`. A stored cache has at most 40 entries."""
    kept = entries.where(F.col(result).isNotNull() & (F.col(result) != ""))
    return kept.withColumn("age", F.row_number().over(W.partitionBy(cache).orderBy(F.coalesce(used, F.lit(0)), place)))

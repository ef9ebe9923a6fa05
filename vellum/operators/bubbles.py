"""Which bubble takes the ink of a text box, and the boxes that come of it.

Masks are run tables, see runs.py: `ink` (page_id, y, x_start, x_end), `bubbles` with a bubble_id. Ink is first cut at the ends of the bubbles in its
row, so each cell has one set of bubbles over it; a box then needs only the pixels and bounds of each such set. The bubbles of a box claim
ink in their order: one takes what is left under it if that is more than `least` pixels, and later ones do not get it. That order matters, so it is
a fold, but over the few sets of one box, in the JVM. Boxes share nothing: each claims from a copy of the page's ink.

Cells and boxes meet in equi-joins on (page_id, y). What is collected for a box are its sets of bubbles, or the runs of its own area.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import pixels, routing, runs
from .detections import green_box
from .grouping import merge_boxes

#: Margin of a routed box, kernels (width, height) that join strokes inside and outside bubbles, least pixels.
PADDING, INSIDE, OUTSIDE = 8, (2, 5), (4, 4)
IN_BUBBLE, FLOATING, LEAST_RECT, LEAST_STRICT = 20, 30, 100, 120
ACTIONS = {"bubble_dialogue": "erase", "floating_dialogue": "careful_erase"}


def ink_cells(ink: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(page_id, y, x_start, x_end, cover): ink cut so that each cell has one set of bubbles over it, as an ascending array."""
    over = runs.merged(bubbles, ("page_id", "bubble_id")).select("page_id", "y", "bubble_id", F.col("x_start").alias("b1"), F.col("x_end").alias("b2"))
    own = runs.merged(ink)
    met = own.join(over, ["page_id", "y"]).where("b1 < x_end AND b2 > x_start").groupBy("page_id", "y", "x_start", "x_end").agg(F.collect_list(F.struct("bubble_id", "b1", "b2")).alias("over"))
    met = own.join(met, ["page_id", "y", "x_start", "x_end"], "left").withColumn("over", F.coalesce("over", F.array().cast("array<struct<bubble_id:int,b1:int,b2:int>>")))
    ends = F.flatten(F.array(F.array("x_start", "x_end"), F.transform("over", lambda b: F.greatest("x_start", b["b1"])), F.transform("over", lambda b: F.least("x_end", b["b2"]))))
    cut = met.withColumn("ends", F.sort_array(F.array_distinct(ends)))
    cover = lambda x: F.sort_array(F.array_distinct(F.transform(F.filter("over", lambda b: (b["b1"] <= x) & (b["b2"] > x)), lambda b: b["bubble_id"])))
    cells = F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x, i: F.struct(x.alias("x_start"), F.get(F.col("ends"), i + 1).alias("x_end"), cover(x).alias("cover")))
    return cut.select("page_id", "y", F.explode(cells).alias("c")).select("page_id", "y", "c.*")


def _in_boxes(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells cut to each box (page_id, box_id, x1, y1, x2, y2) that they lie in."""
    rows = runs.rectangles(boxes, ("page_id", "box_id")).select("page_id", "box_id", "y", F.col("x_start").alias("l"), F.col("x_end").alias("r"))
    met = cells.join(rows, ["page_id", "y"]).where("l < x_end AND r > x_start")
    return met.select("page_id", "box_id", "y", F.greatest("x_start", "l").alias("x_start"), F.least("x_end", "r").alias("x_end"), "cover")


def claims(cells: DataFrame, boxes: DataFrame, least: int = IN_BUBBLE, floating: int = FLOATING) -> DataFrame:
    """(page_id, box_id, bubble_idx, earlier, n, x1, y1, x2, y2): the bubbles that take ink of a box, in their order, with the bubbles
    that took theirs before, and a row of bubble_idx -1 for what is left if that is more than `floating` pixels."""
    by = _in_boxes(cells, boxes).groupBy("page_id", "box_id", "cover").agg(F.sum((F.col("x_end") - F.col("x_start")).cast("long")).alias("n"), F.min("x_start").alias("x1"), F.min("y").alias("y1"), F.max("x_end").alias("x2"), (F.max("y") + 1).alias("y2"))
    sets = by.groupBy("page_id", "box_id").agg(F.collect_list(F.struct("cover", "n", "x1", "y1", "x2", "y2")).alias("sets"))
    count = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    under = lambda b, gone: F.filter("sets", lambda c: F.array_contains(c["cover"], b) & ~F.arrays_overlap(c["cover"], gone))
    none = F.array().cast("array<int>")
    order = F.sort_array(F.array_distinct(F.flatten(F.transform("sets", lambda c: c["cover"]))))
    took = sets.withColumn("order", order).withColumn("took", F.aggregate("order", none, lambda acc, b: F.when(count(under(b, acc)) > least, F.array_append(acc, b)).otherwise(acc)))
    taken = F.transform("took", lambda b, i: F.struct(b.alias("bubble_idx"), F.slice("took", 1, i).alias("earlier"), under(b, F.slice("took", 1, i)).alias("own")))
    left = F.filter("sets", lambda c: ~F.arrays_overlap(c["cover"], F.col("took")))
    rest = F.when(count(left) > floating, F.array(F.struct(F.lit(-1).alias("bubble_idx"), F.col("took").alias("earlier"), left.alias("own")))).otherwise(F.array().cast("array<struct<bubble_idx:int,earlier:array<int>,own:array<struct<cover:array<int>,n:bigint,x1:int,y1:int,x2:int,y2:int>>>>"))
    each = took.select("page_id", "box_id", F.explode(F.concat(taken, rest)).alias("t"))
    low = lambda c: F.array_min(F.transform("t.own", lambda s: s[c])).alias(c)
    high = lambda c: F.array_max(F.transform("t.own", lambda s: s[c])).alias(c)
    return each.select("page_id", "box_id", "t.bubble_idx", "t.earlier", count(F.col("t.own")).alias("n"), low("x1"), low("y1"), high("x2"), high("y2"))


def routes(claimed: DataFrame) -> DataFrame:
    """What a claim means: route, action, mask mode and overlap."""
    held = F.col("bubble_idx") >= 0
    route = F.when(held, "bubble_dialogue").otherwise("floating_dialogue")
    action = F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p])[route]
    return claimed.withColumns({"route": route, "action": action, "mask_mode": F.when(held, "bubble_interior").otherwise("stroke"), "overlap": held.cast("double")})


def claimed_ink(cells: DataFrame, boxes: DataFrame, claimed: DataFrame) -> DataFrame:
    """(page_id, box_id, bubble_idx, y, x_start, x_end): the ink that each claim took."""
    own = _in_boxes(cells, boxes).join(claimed.select("page_id", "box_id", "bubble_idx", "earlier"), ["page_id", "box_id"])
    has = (F.col("bubble_idx") < 0) | F.array_contains("cover", F.col("bubble_idx"))
    return runs.merged(own.where(has & ~F.arrays_overlap("cover", "earlier")), ("page_id", "box_id", "bubble_idx"))


def _raster(spans: list[dict], x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    mask = np.zeros((y2 - y1, x2 - x1), bool)
    for s in spans:
        mask[s["y"] - y1, max(0, s["x_start"] - x1) : max(0, s["x_end"] - x1)] = True
    return mask


def stroke_boxes(spans: list[dict], box: tuple[int, int, int, int], kernel: tuple[int, int], least_rect: int = LEAST_RECT, least: int = LEAST_STRICT) -> list[tuple[int, int, int, int]]:
    """The bounds of a box's ink by component: strokes grown by the kernel form outer components; the rectangle of one has more than least_rect
    pixels, the ink in it at least `least`."""
    x1, y1, x2, y2 = box
    ink = _raster(spans, x1, y1, x2, y2)
    _, labels = pixels.outer_components(pixels.spread(ink, *kernel))
    out = []
    for l, t, r, b in pixels.label_bounds(labels):
        own = pixels.bounds(ink[t:b, l:r])
        if (r - l) * (b - t) > least_rect and own and (own[2] - own[0]) * (own[3] - own[1]) >= least:
            out.append((x1 + l + own[0], y1 + t + own[1], x1 + l + own[2], y1 + t + own[3]))
    return out


_BOXES = "array<struct<x1:int,y1:int,x2:int,y2:int>>"


def _by_group(groups: DataFrame, keys: str, make) -> DataFrame:
    """Rows of a table sent through make(row) -> boxes, many groups an Arrow batch; a row a box."""
    names = groups.columns

    def run(batches):
        for b in batches:
            found = [[dict(zip(("x1", "y1", "x2", "y2"), map(int, x), strict=True)) for x in make(row)] for row in b.to_pylist()]
            kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]))
            yield pa.RecordBatch.from_arrays([*(b.column(k.split()[0]) for k in keys.split(", ")), pa.array(found, kind)], names=[*(k.split()[0] for k in keys.split(", ")), "boxes"])

    assert {k.split()[0] for k in keys.split(", ")} <= set(names)
    found = groups.mapInArrow(run, f"{keys}, boxes {_BOXES}")
    return found.select(*(k.split()[0] for k in keys.split(", ")), F.posexplode("boxes").alias("part", "b")).select(*(k.split()[0] for k in keys.split(", ")), "part", "b.*")


def strict_boxes(taken: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, bubble_idx, part, x1, y1, x2, y2): the boxes of the strokes that each claim took."""
    spans = taken.groupBy("page_id", "box_id", "bubble_idx").agg(F.sort_array(F.collect_list(F.struct("y", "x_start", "x_end"))).alias("spans"))
    rows = spans.join(boxes.select("page_id", "box_id", "x1", "y1", "x2", "y2"), ["page_id", "box_id"])
    return _by_group(rows, "page_id long, box_id int, bubble_idx int", lambda r: stroke_boxes(r["spans"], (r["x1"], r["y1"], r["x2"], r["y2"]), INSIDE if r["bubble_idx"] >= 0 else OUTSIDE))


def _padded(b: Column, bubble: Column, w: Column, h: Column, pad: int = PADDING) -> Column:
    """A routed box with its margin, inside its bubble's bounds or inside the page."""
    held = G.box(F.greatest(bubble["x1"], b["x1"] - pad), F.greatest(bubble["y1"], b["y1"] - pad), F.least(bubble["x2"], b["x2"] + pad), F.least(bubble["y2"], b["y2"] + pad))
    return F.when(bubble.isNotNull(), held).otherwise(G.expanded(b, F.lit(pad), F.lit(pad), w, h))


def routing_state(ink: DataFrame, bubbles: DataFrame, boxes: DataFrame, semantic: DataFrame, sizes: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(page_id, source, source_id, part, bubble_idx, route, action, confidence, x1 .. y2, ex1 .. ey2): text boxes (page_id, box_id, ..) cut to the strokes that
    bubbles or the open page hold, then the semantic regions (page_id, region_id, score, ..) of 100 pixels and more that none of those covers by more than
    0.3: in the first bubble whose mask fills more than 0.4 of them, else floating. `dropped` (page_id, x1, y1, x2, y2): boxes that a reader has
    classified as sound, noise or English, which go; in bubbles semantic regions stay whatever is read."""
    cells = ink_cells(ink, bubbles)
    claimed = claims(cells, boxes)
    strict = strict_boxes(claimed_ink(cells, boxes, claimed), boxes).select("page_id", F.lit("text").alias("source"), F.col("box_id").alias("source_id"), "part", "bubble_idx", F.lit(1.0).alias("confidence"), "x1", "y1", "x2", "y2")
    at = ["page_id", "x1", "y1", "x2", "y2"]
    strict = strict if dropped is None else strict.join(dropped.select(*at).distinct(), at, "left_anti")
    free = routing.uncovered(semantic, strict)
    over = runs.merged(bubbles, ("page_id", "bubble_id")).select("page_id", "y", "bubble_id", F.col("x_start").alias("b1"), F.col("x_end").alias("b2"))
    rows = runs.rectangles(free, ("page_id", "region_id")).join(over, ["page_id", "y"]).where("b1 < x_end AND b2 > x_start")
    filled = rows.groupBy("page_id", "region_id", "bubble_id").agg(F.sum(F.least("x_end", "b2") - F.greatest("x_start", "b1")).alias("n"))
    first = filled.join(free.select("page_id", "region_id", G.area(G.of()).alias("area")), ["page_id", "region_id"]).where(F.col("n") / F.col("area") > 0.4).groupBy("page_id", "region_id").agg(F.min("bubble_id").alias("b"))
    extra = free.join(first, ["page_id", "region_id"], "left").select("page_id", F.lit("semantic").alias("source"), F.col("region_id").alias("source_id"), F.lit(0).alias("part"), F.coalesce("b", F.lit(-1)).alias("bubble_idx"), F.col("score").cast("double").alias("confidence"), "x1", "y1", "x2", "y2")
    if dropped is not None:
        extra = extra.where("bubble_idx >= 0").unionByName(extra.where("bubble_idx < 0").join(dropped.select(*at).distinct(), at, "left_anti"))
    held = runs.measures(runs.merged(bubbles, ("page_id", "bubble_id")), ("page_id", "bubble_id")).select("page_id", F.col("bubble_id").alias("bubble_idx"), G.of().alias("bubble"))
    out = routes(strict.unionByName(extra)).join(held, ["page_id", "bubble_idx"], "left").join(sizes, "page_id")
    return padded(out, F.col("bubble")).select("page_id", "source", "source_id", "part", "bubble_idx", "route", "action", "confidence", "x1", "y1", "x2", "y2", "ex1", "ey1", "ex2", "ey2")


def padded(routed: DataFrame, bubble: Column) -> DataFrame:
    """Routed boxes with their margin as ex1 .. ey2; `bubble`: the bounds of their bubble, null without one."""
    out = routed.withColumn("e", _padded(G.of(), bubble, F.col("w"), F.col("h")))
    return out.select("*", *[F.col(f"e.{c}").alias(f"e{c}") for c in ("x1", "y1", "x2", "y2")]).drop("e")


def rescue_box(bubble: list[dict]) -> tuple[int, int, int, int] | None:
    """The largest rectangle in the part of a bubble at its centroid, or at the nearest point of the first square around it (sides 2 * r for r = 1, 6, .. 46,
    upper and lower side, every fifth pixel) that meets the bubble."""
    l, t = min(s["x_start"] for s in bubble), min(s["y"] for s in bubble)
    mask = _raster(bubble, l, t, max(s["x_end"] for s in bubble), max(s["y"] for s in bubble) + 1)
    ys, xs = np.nonzero(mask)
    cx, cy = int((xs + l).mean()) - l, int((ys + t).mean()) - t
    labels = pixels.components(mask)[1]
    own = int(labels[cy, cx])
    for r in range(1, 51, 5) if not own else ():
        near = [(dx * dx + r * r, i, int(labels[cy + dy, cx + dx])) for i, (dy, dx) in enumerate((dy, dx) for dy in (-r, r) for dx in range(-r, r + 1, 5)) if 0 <= cy + dy < mask.shape[0] and 0 <= cx + dx < mask.shape[1] and labels[cy + dy, cx + dx]]
        if near:
            own = min(near)[2]
            break
    box = pixels.largest_rectangle(labels == own) if own else None
    return (box[0] + l, box[1] + t, box[2] + l, box[3] + t) if box else None


def rescues(bubbles: DataFrame, routed: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, bubble_idx, x1, y1, x2, y2): where a reader should look in the bubbles that no routed box is in; rectangles of more than `least` pixels."""
    keys = ["page_id", "bubble_id"]
    free = routing.unrouted(runs.merged(bubbles, tuple(keys)), routed)
    spans = free.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x_start", "x_end"))).alias("spans"))
    found = _by_group(spans, "page_id long, bubble_id int", lambda r: [x for x in (rescue_box(r["spans"]),) if x])
    return found.where(G.area(G.of()) > least).select("page_id", F.col("bubble_id").alias("bubble_idx"), "x1", "y1", "x2", "y2")


def cluster_boxes(ink: list[dict], bubble: list[dict], w: int, h: int) -> list[tuple[int, ...]]:
    """The text clusters of a bubble, each with the bounds of its territory: (x1, y1, x2, y2, gx1, gy1, gx2, gy2). Strokes closed by 12 x 30 form
    outer components; boxes of 30 pixels and more grow together (merge_boxes); the bubble, less 6 % at its border, is dealt to the nearest
    box; a territory's largest part counts, and a box without one is its own territory. Closing by an even kernel moves strokes by a pixel (see
    pixels.closed), and a cluster is the ink inside what was closed, so its first row and column go."""
    reach = 32
    ends = lambda spans: (min(s["x_start"] for s in spans), min(s["y"] for s in spans), max(s["x_end"] for s in spans), max(s["y"] for s in spans) + 1)
    bx1, by1, bx2, by2 = ends(bubble)
    l, t, r, b = max(0, bx1 - reach), max(0, by1 - reach), min(w, bx2 + reach), min(h, by2 + reach)
    canvas, area = _raster(ink, l, t, r, b), _raster(bubble, l, t, r, b)
    count, labels = pixels.outer_components(pixels.closed(canvas, 12, 30))
    filled, found = pixels.filled(labels), []
    for j, (x1, y1, x2, y2) in enumerate(pixels.label_bounds(labels), 1):
        own = pixels.bounds(canvas & (filled == j)) if (x2 - x1) * (y2 - y1) >= 30 else None
        if own and (own[2] - own[0]) * (own[3] - own[1]) >= 30:
            found.append(list(own))
    found = merge_boxes(found)
    if not found:
        return []
    size = max(7, int(min(bx2 - 1 - bx1, by2 - 1 - by1) * 0.06))
    safe = pixels.shrunk(area, size, size)
    safe = safe if safe.any() else area
    zone = np.where(safe, pixels.nearest_box(safe.shape, [(x1, y1, x2 + 1, y2 + 1) for x1, y1, x2, y2 in found]), -1)
    out = []
    for i, box in enumerate(found):
        n, own = pixels.components(zone == i)
        green = tuple(box)
        if n:
            best = int(np.bincount(own.ravel())[1:].argmax()) + 1
            gx1, gy1, gx2, gy2 = pixels.bounds(own == best)
            if (gx2 - gx1 > 1) + (gy2 - gy1 > 1) == 2:  # an outline of three points and more
                green = (gx1, gy1, gx2 - 1, gy2 - 1)
        out.append(tuple(v + (l, t)[k % 2] for k, v in enumerate((*box, *green))))
    return out


def floating_boxes(ink: list[dict], w: int, h: int) -> list[tuple[int, int, int, int]]:
    """The text clusters outside bubbles: strokes closed by 12 x 12, of 300 pixels and 10 a side at least."""
    _, labels = pixels.outer_components(pixels.closed(_raster(ink, 0, 0, w, h), 12, 12))
    return [x for x in pixels.label_bounds(labels) if (x[2] - x[0]) * (x[3] - x[1]) >= 300 and min(x[2] - x[0], x[3] - x[1]) >= 10]


def consolidated(ink: DataFrame, bubbles: DataFrame, routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, bubble_idx, cluster, route, action, mask_mode, confidence, x1 .. y2, gx1 .. gy2): clusters of each bubble and of what no bubble with clusters
    covers, with the commonest route and highest score of the routed boxes (page_id, route, score, ..) that they meet (0.5 without one)
    and the layout box: a cluster's territory, or for floating ones the box grown by 1.118, both as green_box() wants."""
    keys = ("page_id", "bubble_id")
    over = runs.merged(bubbles, keys)
    pages = over.select(*keys).distinct().join(ink, "page_id").select(*keys, "y", "x_start", "x_end")
    inside = runs.intersection(pages, over, keys)
    spans = lambda df, name, by: df.groupBy(*by).agg(F.collect_list(F.struct("y", "x_start", "x_end")).alias(name))
    rows = spans(inside, "ink", keys).join(spans(over, "bubble", keys), list(keys)).join(sizes, "page_id")

    def run(batches):
        for b in batches:
            found = [[list(map(int, x)) for x in cluster_boxes(r["ink"], r["bubble"], r["w"], r["h"])] for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("bubble_id"), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["page_id", "bubble_id", "boxes"])

    corners = ("x1", "y1", "x2", "y2")
    made = rows.mapInArrow(run, "page_id long, bubble_id int, boxes array<array<int>>").select("page_id", F.col("bubble_id").alias("bubble_idx"), F.posexplode("boxes").alias("part", "b"))
    made = made.select("page_id", "bubble_idx", "part", *[F.col("b")[i].alias(c) for i, c in enumerate(corners)], G.box(*(F.col("b")[i] for i in range(4, 8))).alias("green"))
    handled = over.join(made.select("page_id", F.col("bubble_idx").alias("bubble_id")).distinct(), list(keys), "left_semi").select("page_id", "y", "x_start", "x_end")
    free = spans(runs.difference(ink, handled), "ink", ("page_id",)).join(sizes, "page_id")
    loose = _by_group(free, "page_id long", lambda r: floating_boxes(r["ink"], r["w"], r["h"])).join(sizes, "page_id")
    loose = loose.select("page_id", F.lit(-1).alias("bubble_idx"), "part", *corners, G.floating_growth(G.of(), F.col("w"), F.col("h")).alias("green"))
    every = made.unionByName(loose).withColumn("cluster", F.struct("bubble_idx", "part"))
    route = routing.modal_route(every, routed)
    held = runs.measures(over, keys).select("page_id", F.col("bubble_id").alias("bubble_idx"), G.of().alias("bubble"))
    return settled(every.join(route, ["page_id", "cluster"]).join(held, ["page_id", "bubble_idx"], "left"))


def settled(clusters: DataFrame) -> DataFrame:
    """Clusters (.., green, bubble, route, confidence) with route, action, mask mode and layout box."""
    corners = ("x1", "y1", "x2", "y2")
    inner = F.col("bubble_idx") >= 0
    state = F.when(~inner & (F.col("route") == "bubble_dialogue"), "floating_dialogue").otherwise(F.col("route"))
    out = clusters.withColumn("route", state).withColumn("g", green_box(G.of(), F.col("green"), F.col("bubble")))
    action = F.when(inner, "erase").when(F.col("route") == "floating_dialogue", "careful_erase").otherwise("skip_protect")
    return out.select("page_id", "bubble_idx", F.col("part").alias("cluster"), "route", action.alias("action"), F.when(inner, "bubble_interior").otherwise("stroke").alias("mask_mode"), F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.5).alias("confidence"), *corners, *[F.col(f"g.{c}").alias(f"g{c}") for c in corners])

"""Boxes as Column expressions. A box is a struct of x1, y1, x2, y2, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def of(prefix: str = "") -> Column:
    return box(*[F.col(prefix + n) for n in ("x1", "y1", "x2", "y2")])


def width(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def clamp(x1, y1, x2, y2, w: Column, h: Column) -> Column:
    return box(F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1), F.least(w, x2), F.least(h, y2))


def expanded(b: Column, px: Column, py: Column, w: Column, h: Column) -> Column:
    return clamp(b["x1"] - px, b["y1"] - py, b["x2"] + px, b["y2"] + py, w, h)


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def overlap(a: Column, b: Column) -> Column:
    """Intersection by the smaller area."""
    return intersection(a, b) / F.least(F.greatest(F.lit(1), area(a)), F.greatest(F.lit(1), area(b)))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    return i / (area(a) + area(b) - i + F.lit(1e-6).cast("double"))


def gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(lo_a, lo_b) - F.least(hi_a, hi_b))


def rotated(b: Column, angle: Column, w: Column, h: Column) -> Column:
    """A box found on a turned page, on the page; rounds half to even."""
    low = lambda x, y: F.bround(F.least(x, y).cast("double"), 0)
    high = lambda x, y: F.bround(F.greatest(x, y).cast("double"), 0)
    xs = F.when(angle == 270, F.struct(b["y1"].alias("a"), b["y2"].alias("b"))).when(angle == 90, F.struct((w - b["y1"]).alias("a"), (w - b["y2"]).alias("b"))).when(angle == 180, F.struct((w - b["x1"]).alias("a"), (w - b["x2"]).alias("b"))).otherwise(F.struct(b["x1"].alias("a"), b["x2"].alias("b")))
    ys = F.when(angle == 270, F.struct((h - b["x1"]).alias("a"), (h - b["x2"]).alias("b"))).when(angle == 90, F.struct(b["x1"].alias("a"), b["x2"].alias("b"))).when(angle == 180, F.struct((h - b["y1"]).alias("a"), (h - b["y2"]).alias("b"))).otherwise(F.struct(b["y1"].alias("a"), b["y2"].alias("b")))
    return clamp(low(xs["a"], xs["b"]), low(ys["a"], ys["b"]), high(xs["a"], xs["b"]), high(ys["a"], ys["b"]), w, h)


def vertical_layout(b: Column, w: Column, h: Column) -> Column:
    """Room for horizontal text around a column of characters, slid inside the page."""
    bw, bh = F.greatest(F.lit(1), width(b)), F.greatest(F.lit(1), height(b))
    tall = bh >= bw * 1.7
    tw = F.least(w, F.when(tall, F.greatest(bw + 48, F.lit(96), (bh * 0.45).cast("int"))).otherwise(F.greatest(bw + 32, (bw * 1.35).cast("int"))))
    th = F.least(h, F.when(tall, bh + F.greatest(F.lit(18), (bh * 0.08).cast("int"))).otherwise(bh + 20))
    half = lambda c: F.floor(c / 2).cast("int")
    x1 = F.greatest(F.lit(0), F.least(w - tw, half(b["x1"] + b["x2"]) - half(tw)))
    y1 = F.greatest(F.lit(0), F.least(h - th, half(b["y1"] + b["y2"]) - half(th)))
    return box(x1, y1, x1 + tw, y1 + th)


def floating_growth(b: Column, w: Column, h: Column, scale: float = 1.118) -> Column:
    cx, cy = b["x1"] + width(b) / 2, b["y1"] + height(b) / 2
    dx, dy = width(b) * F.lit(scale) / 2, height(b) * F.lit(scale) / 2
    cut = lambda c: c.cast("int")
    return clamp(cut(cx - dx), cut(cy - dy), cut(cx + dx), cut(cy + dy), w, h)


def crop_bounds(b: Column, w: Column, h: Column) -> Column:
    """A square of context around a box, shifted inwards at the borders."""
    half = F.greatest(F.lit(256), F.least(F.lit(512), F.floor(F.greatest(width(b), height(b)) / 2).cast("int") + 220))
    cx, cy = F.floor((b["x1"] + b["x2"]) / 2).cast("int"), F.floor((b["y1"] + b["y2"]) / 2).cast("int")
    x1, y1 = F.greatest(F.lit(0), cx - half), F.greatest(F.lit(0), cy - half)
    x2, y2 = F.least(w, cx + half), F.least(h, cy + half)

    def filled(lo: Column, hi: Column, most: Column) -> tuple[Column, Column]:
        short = hi - lo < F.least(most, 2 * half)
        return F.when(short & (lo != 0) & (hi == most), F.greatest(F.lit(0), most - 2 * half)).otherwise(lo), F.when(short & (lo == 0), F.least(most, 2 * half)).otherwise(hi)

    x1, x2 = filled(x1, x2, w)
    y1, y2 = filled(y1, y2, h)
    return box(x1, y1, x2, y2)


def coerced(b: Column, w: Column, h: Column) -> Column:
    """Clamped to the page and at least one pixel wide and high."""
    l, t = F.greatest(F.lit(0), F.least(w, b["x1"])), F.greatest(F.lit(0), F.least(h, b["y1"]))
    r, u = F.greatest(F.lit(0), F.least(w, b["x2"])), F.greatest(F.lit(0), F.least(h, b["y2"]))
    return box(l, t, F.when(r <= l, F.least(w, l + 1)).otherwise(r), F.when(u <= t, F.least(h, t + 1)).otherwise(u))


def render_scale(w: Column, target: int = 900, most: int = 3) -> Column:
    return F.when(w >= target, 1).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.lit(target) / w).cast("int"))))


def page_column(b: Column, h: Column) -> Column:
    """Whether a box is a tall vertical column of the page."""
    return (height(b) >= F.greatest(F.lit(80), (h * 0.18).cast("int"))) & (height(b) >= width(b) * 4)


def vertical_link(a: Column, b: Column, w: Column, h: Column) -> Column:
    """Whether two columns belong to one text."""
    uw = F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])
    uh = F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])
    uw, uh = F.least(uw, w), F.least(uh, h)
    far = ((uh > (h * 0.72).cast("int")) & (uw > (w * 0.24).cast("int"))) | (F.abs((a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2) > h * F.lit(0.30))
    pad = lambda x: expanded(x, F.lit(8), F.lit(14), w, h)
    shared = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    side = F.greatest(F.lit(14), (w * 0.018).cast("int"))
    side = F.when(uw > (w * 0.30).cast("int"), F.least(side, F.lit(16))).otherwise(side)
    beside = (shared / F.greatest(F.lit(1), F.least(height(a), height(b))) >= 0.45) & (gap(a["x1"], a["x2"], b["x1"], b["x2"]) <= side)
    return ~far & ((intersection(pad(a), pad(b)) > 0) | beside)


def line_link(p: Column, c: Column) -> Column:
    """Whether line c continues line p."""
    tall = F.greatest(height(p), height(c))
    near = c["y1"] - p["y2"] <= F.greatest(F.lit(32), (tall * 1.35).cast("int"))
    shared = F.greatest(F.lit(0), F.least(p["x2"], c["x2"]) - F.greatest(p["x1"], c["x1"]))
    wide = F.greatest(width(p), width(c))
    left = F.abs(p["x1"] - c["x1"]) <= F.greatest(F.lit(22), (wide * 0.18).cast("int"))
    centre = F.abs((p["x1"] + p["x2"]) / 2 - (c["x1"] + c["x2"]) / 2) <= F.greatest(F.lit(34), (wide * 0.32).cast("int"))
    strong = shared >= (F.greatest(F.lit(1), F.least(width(p), width(c))) * 0.35).cast("int")
    return near & (strong | left | centre)

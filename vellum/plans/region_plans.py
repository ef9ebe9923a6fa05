"""Queries over boxes, groups of boxes, and bubbles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import dedupe, grouping, routing
from ..sources import fixtures as fx
from .fixture_sql import BUBBLES, PLACED, REGIONS, TEXTS



def _page():
    return F.col("img_w"), F.col("img_h")


def _boxes(make):
    """A query that gives a new box for each region."""
    return lambda spark, d: fx.regions(spark, d).withColumn("b", G.of()).withColumn("r", make(F.col("b"))).select("page_id", "region_id", *[F.col(f"r.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _derive(spark, d):
    b = F.col("b")
    return fx.regions(spark, d).withColumn("b", G.of()).select("page_id", "region_id", G.width(b).alias("w"), G.height(b).alias("h"), G.area(b).alias("area"), ((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), G.page_column(b, F.col("img_h")).alias("tall_column"), G.render_scale(G.width(b) * 5).alias("scale"))


def _resized(spark, d):
    w, h = (F.col("x2") - F.col("x1")) * 13, (F.col("y2") - F.col("y1")) * 7
    ratio = F.least(F.lit(1800) / w, F.lit(1800) / h)
    small = (w <= 1800) & (h <= 1800)
    size = lambda x: F.when(small, x).otherwise(F.floor(x * ratio + 0.5).cast("int"))
    return fx.regions(spark, d).select("page_id", "region_id", size(w).alias("w"), size(h).alias("h"))


def _clusters(spark, d):
    return grouping.line_clusters(fx.regions(spark, d))


def _groups(spark, d):
    r = fx.regions(spark, d)
    return grouping.vertical_groups(r)


def _chunks(spark, d):
    r = fx.regions(spark, d)
    return grouping.overwide_chunks(grouping.vertical_groups(r).join(r, ["page_id", "region_id"]))


def _routed(spark, d):
    return routing.best_bubble(fx.regions(spark, d), fx.bubbles(spark, d))


def _uncovered(spark, d):
    r = fx.regions(spark, d)
    return routing.uncovered(r.where("region_id % 2 = 1"), r.where("region_id % 2 = 0")).select("page_id", "region_id")


def _modal(spark, d):
    r = fx.regions(spark, d)
    route = F.element_at(F.array(*map(F.lit, ("bubble_dialogue", "floating_dialogue", "onomatopoeia"))), (F.col("region_id") % 3 + 1))
    return routing.modal_route(grouping.cluster_items(grouping.line_clusters(r)), r.withColumn("route", route))


def _crops(spark, d):
    r = fx.regions(spark, d).select("page_id", "region_id", "score", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("y2") - F.col("y1")).alias("h"))
    return grouping.combined_crops(fx.placed(r, fx.texts(spark, d)).withColumn("group_id", (F.col("region_id") % 2).cast("int")))


QUERIES = {
    "box_derive": _derive,
    "box_expand": _boxes(lambda b: G.expanded(b, F.lit(8), F.lit(8), *_page())),
    "rotate_box": _boxes(lambda b: G.rotated(b, F.col("region_id") % 4 * 90, *_page())),
    "vertical_layout_box": _boxes(lambda b: G.vertical_layout(b, *_page())),
    "floating_growth": _boxes(lambda b: G.floating_growth(b, *_page())),
    "crop_bounds": _boxes(lambda b: G.crop_bounds(b, *_page())),
    "coerce_box": _boxes(lambda b: G.coerced(G.box(b["x1"] - 300, b["y1"] + 500, b["x2"] - 350, b["y2"] + 300), *_page())),
    "resize_dims": _resized,
    "overlap_pairs": lambda spark, d: routing.pairs(fx.regions(spark, d), G.overlap, "overlap"),
    "iou_pairs": lambda spark, d: routing.pairs(fx.regions(spark, d), G.iou, "iou"),
    "nms_keep": lambda spark, d: dedupe.nms(fx.regions(spark, d)),
    "overlap_dedupe": lambda spark, d: dedupe.overlap_dedupe(fx.regions(spark, d)),
    "quantised_dedupe": lambda spark, d: dedupe.quantised_dedupe(fx.regions(spark, d).withColumn("t", F.col("txt_len") % 3), "t", 60).select("page_id", "region_id"),
    "renumber_items": lambda spark, d: dedupe.renumbered(fx.regions(spark, d)).select("page_id", "region_id", "item_id"),
    "line_clusters": lambda spark, d: _clusters(spark, d).select("page_id", "region_id", "cluster"),
    "cluster_items": lambda spark, d: grouping.cluster_items(_clusters(spark, d)).withColumn("confidence", F.round("confidence", 6)),
    "vertical_groups": _groups,
    "overwide_chunks": _chunks,
    "best_bubble": lambda spark, d: _routed(spark, d).select("page_id", "region_id", "bubble_idx"),
    "first_bubble": lambda spark, d: routing.first_bubble(fx.regions(spark, d), fx.bubbles(spark, d)),
    "uncovered_regions": _uncovered,
    "unrouted_bubbles": lambda spark, d: routing.unrouted(fx.bubbles(spark, d), _routed(spark, d)).select("page_id", "bubble_id"),
    "modal_route": _modal,
    "crop_texts": lambda spark, d: _crops(spark, d).withColumn("confidence", F.round("confidence", 6)),
    "box_merge_fixpoint": lambda spark, d: grouping.merged_boxes(fx.regions(spark, d)),
}


def _int(x: str) -> str:
    return f"CAST(trunc({x}) AS INT)"


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def over(a: str, b: str) -> str:
    return f"({inter(a, b)} / least(greatest(1, {area(a)}), greatest(1, {area(b)})))"


def iou(a: str, b: str) -> str:
    return f"({inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)} + CAST(1e-6 AS DOUBLE)))"


def _all(select: str) -> str:
    return f"WITH {REGIONS} SELECT page_id, region_id, {select} FROM fx_regions"


def _fold(order: str, clash: str) -> str:
    return f"""WITH {REGIONS}, p AS (SELECT page_id, list([{{'id': region_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY {order}) AS rows FROM fx_regions GROUP BY page_id)
SELECT page_id, unnest(list_transform(list_reduce(rows, lambda acc, r: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_concat(acc, r) END), lambda k: k.id)) AS region_id FROM p"""


def _clash(measure) -> str:
    return measure("k", "r[1]")


LINES = f"""{REGIONS}, banded AS (SELECT *, round_even(y1 / greatest(10.0::DOUBLE, median(y2 - y1) OVER (PARTITION BY page_id) * 0.75::DOUBLE), 0) AS band FROM fx_regions),
lagged AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM banded WINDOW w AS (PARTITION BY page_id ORDER BY band, x1, region_id)),
linked AS (SELECT *, CASE WHEN px1 IS NOT NULL AND y1 - py2 <= greatest(32, {_int("greatest(py2 - py1, y2 - y1) * 1.35::DOUBLE")}) AND (
  greatest(0, least(px2, x2) - greatest(px1, x1)) >= {_int("greatest(1, least(px2 - px1, x2 - x1)) * 0.35::DOUBLE")}
  OR abs(px1 - x1) <= greatest(22, {_int("greatest(px2 - px1, x2 - x1) * 0.18::DOUBLE")})
  OR abs((px1 + px2) / 2 - (x1 + x2) / 2) <= greatest(34, {_int("greatest(px2 - px1, x2 - x1) * 0.32::DOUBLE")})) THEN 0 ELSE 1 END AS new FROM lagged),
clustered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY band, x1, region_id) - 1 AS INT) AS cluster FROM linked),
items AS (SELECT page_id, cluster, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_lines, sum(score * greatest(1, txt_len)) / sum(greatest(1, txt_len)) AS confidence FROM clustered GROUP BY ALL)"""

_UW, _UH = "least(800, greatest(a.x2, b.x2) - least(a.x1, b.x1))", "least(1200, greatest(a.y2, b.y2) - least(a.y1, b.y1))"
_PAD = "(greatest(0, least(least(800, a.x2 + 8), least(800, b.x2 + 8)) - greatest(greatest(0, a.x1 - 8), greatest(0, b.x1 - 8))) > 0 AND greatest(0, least(least(1200, a.y2 + 14), least(1200, b.y2 + 14)) - greatest(greatest(0, a.y1 - 14), greatest(0, b.y1 - 14))) > 0)"
GROUPS = f"""{REGIONS}, links AS (SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM fx_regions a JOIN fx_regions b USING (page_id)
  WHERE NOT ({_UH} > 864 AND {_UW} > 192) AND abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= 360 AND ({_PAD} OR (
    greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(1, least(a.y2 - a.y1, b.y2 - b.y1)) >= 0.45
    AND greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) <= CASE WHEN {_UW} > 240 THEN 14 ELSE 14 END))),
reach AS (SELECT page_id, region_id AS a, region_id AS b FROM fx_regions UNION SELECT r.page_id, r.a, l.b FROM reach r JOIN links l ON l.page_id = r.page_id AND l.a = r.b),
grouped AS (SELECT page_id, CAST(min(b) AS INT) AS group_id, a AS region_id FROM reach GROUP BY page_id, a)"""

SHARES = f"""{REGIONS}, {BUBBLES}, shares AS (SELECT a.page_id, a.region_id, b.bubble_id, {inter("a", "b")} / greatest(1, {area("a")}) AS share FROM fx_regions a JOIN fx_bubbles b USING (page_id)),
best AS (SELECT r.*, coalesce(s.bubble_id, -1) AS bubble_idx FROM fx_regions r LEFT JOIN (SELECT * FROM shares WHERE share >= 0.18 QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY share DESC, bubble_id) = 1) s USING (page_id, region_id))"""

_W13, _H7 = "((x2 - x1) * 13)", "((y2 - y1) * 7)"
_SMALL = f"{_W13} <= 1800 AND {_H7} <= 1800"
_RATIO = f"least(1800 / {_W13}, 1800 / {_H7})"
_TALL = "(y2 - y1 >= (x2 - x1) * 1.7::DOUBLE)"
_TW = f"least(800, CASE WHEN {_TALL} THEN greatest(x2 - x1 + 48, 96, {_int('(y2 - y1) * 0.45::DOUBLE')}) ELSE greatest(x2 - x1 + 32, {_int('(x2 - x1) * 1.35::DOUBLE')}) END)"
_TH = f"least(1200, CASE WHEN {_TALL} THEN y2 - y1 + greatest(18, {_int('(y2 - y1) * 0.08::DOUBLE')}) ELSE y2 - y1 + 20 END)"
_HALF = "greatest(256, least(512, greatest(x2 - x1, y2 - y1) // 2 + 220))"


def _crop(axis: str, most: int) -> str:
    lo, hi = f"greatest(0, ({axis}1 + {axis}2) // 2 - {_HALF})", f"least({most}, ({axis}1 + {axis}2) // 2 + {_HALF})"
    short = f"{hi} - {lo} < least({most}, 2 * {_HALF})"
    return f"CAST(CASE WHEN {short} AND {lo} <> 0 AND {hi} = {most} THEN greatest(0, {most} - 2 * {_HALF}) ELSE {lo} END AS INT) AS {axis}1, CAST(CASE WHEN {short} AND {lo} = 0 THEN least({most}, 2 * {_HALF}) ELSE {hi} END AS INT) AS {axis}2"


_GROW = "{c} {s} ({w}) * 1.118::DOUBLE / 2"
_ROT = "CASE region_id % 4 WHEN 3 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END"

SQL = {
    "box_derive": _all("x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 >= 216 AND y2 - y1 >= (x2 - x1) * 4 AS tall_column, CAST(CASE WHEN (x2 - x1) * 5 >= 900 THEN 1 ELSE least(3, ceil(900 / ((x2 - x1) * 5))) END AS INT) AS scale"),
    "box_expand": _all("greatest(0, x1 - 8) AS x1, greatest(0, y1 - 8) AS y1, least(800, x2 + 8) AS x2, least(1200, y2 + 8) AS y2"),
    "rotate_box": _all(", ".join([f"greatest(0, {_ROT.format(a='y1', b='800 - y2', c='800 - x2', d='x1')}) AS x1", f"greatest(0, {_ROT.format(a='1200 - x2', b='x1', c='1200 - y2', d='y1')}) AS y1", f"least(800, {_ROT.format(a='y2', b='800 - y1', c='800 - x1', d='x2')}) AS x2", f"least(1200, {_ROT.format(a='1200 - x1', b='x2', c='1200 - y1', d='y2')}) AS y2"])),
    "vertical_layout_box": f"SELECT page_id, region_id, CAST(l AS INT) AS x1, CAST(t AS INT) AS y1, CAST(l + tw AS INT) AS x2, CAST(t + th AS INT) AS y2 FROM (WITH {REGIONS} SELECT *, greatest(0, least(800 - tw, (x1 + x2) // 2 - tw // 2)) AS l, greatest(0, least(1200 - th, (y1 + y2) // 2 - th // 2)) AS t FROM (SELECT *, {_TW} AS tw, {_TH} AS th FROM fx_regions))",
    "floating_growth": _all(", ".join([f"greatest(0, {_int(_GROW.format(c='(x1 + (x2 - x1) / 2)', s='-', w='x2 - x1'))}) AS x1", f"greatest(0, {_int(_GROW.format(c='(y1 + (y2 - y1) / 2)', s='-', w='y2 - y1'))}) AS y1", f"least(800, {_int(_GROW.format(c='(x1 + (x2 - x1) / 2)', s='+', w='x2 - x1'))}) AS x2", f"least(1200, {_int(_GROW.format(c='(y1 + (y2 - y1) / 2)', s='+', w='y2 - y1'))}) AS y2"])),
    "crop_bounds": _all(_crop("x", 800) + ", " + _crop("y", 1200)),
    "coerce_box": f"SELECT page_id, region_id, l AS x1, t AS y1, CASE WHEN r <= l THEN least(800, l + 1) ELSE r END AS x2, CASE WHEN u <= t THEN least(1200, t + 1) ELSE u END AS y2 FROM (WITH {REGIONS} SELECT page_id, region_id, greatest(0, least(800, x1 - 300)) AS l, greatest(0, least(1200, y1 + 500)) AS t, greatest(0, least(800, x2 - 350)) AS r, greatest(0, least(1200, y2 + 300)) AS u FROM fx_regions)",
    "resize_dims": _all(f"CASE WHEN {_SMALL} THEN {_W13} ELSE CAST(floor({_W13} * {_RATIO} + 0.5) AS INT) END AS w, CASE WHEN {_SMALL} THEN {_H7} ELSE CAST(floor({_H7} * {_RATIO} + 0.5) AS INT) END AS h"),
    "overlap_pairs": f"WITH {REGIONS} SELECT a.page_id, a.region_id AS a, b.region_id AS b, {over('a', 'b')} AS overlap FROM fx_regions a JOIN fx_regions b ON a.page_id = b.page_id AND a.region_id < b.region_id WHERE {inter('a', 'b')} > 0",
    "iou_pairs": f"WITH {REGIONS} SELECT a.page_id, a.region_id AS a, b.region_id AS b, {iou('a', 'b')} AS iou FROM fx_regions a JOIN fx_regions b ON a.page_id = b.page_id AND a.region_id < b.region_id WHERE {inter('a', 'b')} > 0",
    "nms_keep": _fold("-score, region_id", f"{_clash(iou)} > 0.45"),
    "overlap_dedupe": _fold("region_id", f"{_clash(over)} > 0.72"),
    "quantised_dedupe": f"WITH {REGIONS} SELECT page_id, region_id FROM fx_regions QUALIFY row_number() OVER (PARTITION BY page_id, txt_len % 3, x1 // 60, y1 // 60, x2 // 60, y2 // 60 ORDER BY region_id) = 1",
    "renumber_items": _all("CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, region_id) - 1 AS INT) AS item_id"),
    "line_clusters": f"WITH {LINES} SELECT page_id, region_id, cluster FROM clustered",
    "cluster_items": f"WITH {LINES} SELECT page_id, cluster, x1, y1, x2, y2, n_lines, round(confidence, 6) AS confidence FROM items",
    "vertical_groups": f"WITH RECURSIVE {GROUPS} SELECT * FROM grouped",
    "overwide_chunks": f"""WITH RECURSIVE {GROUPS}, m AS (SELECT g.*, x2 - x1 AS w, y2 - y1 AS h, x1, x2, row_number() OVER o - 1 AS pos, count(*) OVER g AS n, max(x2) OVER g - min(x1) OVER g AS wide
  FROM grouped g JOIN fx_regions USING (page_id, region_id) WINDOW g AS (PARTITION BY page_id, group_id), o AS (PARTITION BY page_id, group_id ORDER BY x1, region_id)),
t AS (SELECT page_id, group_id, list_sort(list(w) FILTER (h >= 216 AND h >= w * 4)) AS ws FROM m GROUP BY ALL)
SELECT page_id, group_id, region_id, CAST(CASE WHEN n >= 4 AND len(ws) >= 4 AND wide > greatest(90, 88, {_int("ws[len(ws) // 2 + 1] * 2.9::DOUBLE")})
  THEN CASE WHEN n % k = 1 AND pos = n - 1 THEN pos // k - 1 ELSE pos // k END ELSE 0 END AS INT) AS chunk FROM (SELECT *, CASE WHEN n <= 5 THEN 2 ELSE 3 END AS k FROM m JOIN t USING (page_id, group_id))""",
    "best_bubble": f"WITH {SHARES} SELECT page_id, region_id, bubble_idx FROM best",
    "first_bubble": f"WITH {SHARES} SELECT page_id, region_id, min(bubble_id) AS bubble_id FROM shares WHERE share > 0.4 GROUP BY ALL",
    "uncovered_regions": f"WITH {REGIONS} SELECT page_id, region_id FROM fx_regions a WHERE region_id % 2 = 1 AND {area('a')} >= 100 AND NOT EXISTS (SELECT 1 FROM fx_regions b WHERE b.page_id = a.page_id AND b.region_id % 2 = 0 AND {over('a', 'b')} > 0.3)",
    "unrouted_bubbles": f"WITH {SHARES} SELECT page_id, bubble_id FROM fx_bubbles b WHERE NOT EXISTS (SELECT 1 FROM best r WHERE r.page_id = b.page_id AND r.bubble_idx = b.bubble_id)",
    "modal_route": f"""WITH {LINES}, met AS (SELECT c.page_id, c.cluster, CASE r.region_id % 3 WHEN 0 THEN 'bubble_dialogue' WHEN 1 THEN 'floating_dialogue' ELSE 'onomatopoeia' END AS route, r.score FROM items c JOIN fx_regions r ON r.page_id = c.page_id AND {inter("c", "r")} > 0),
n AS (SELECT page_id, cluster, route, count(*) AS n FROM met GROUP BY ALL), top AS (SELECT page_id, cluster, max(score) AS confidence FROM met GROUP BY ALL)
SELECT c.page_id, c.cluster, coalesce(m.route, 'bubble_dialogue') AS route, coalesce(t.confidence, 0.0::DOUBLE) AS confidence FROM items c
LEFT JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page_id, cluster ORDER BY n DESC, route) = 1) m USING (page_id, cluster) LEFT JOIN top t USING (page_id, cluster)""",
    "crop_texts": f"""WITH {TEXTS}, {REGIONS}, {PLACED.format(boxes="fx_regions")}, l AS (SELECT page_id, CAST(region_id % 2 AS INT) AS group_id, region_id, trim(text, ' ') AS text, score, x1 AS x, round_even(y1 / greatest(8.0::DOUBLE, (y2 - y1) * 0.7::DOUBLE), 0) AS band FROM placed)
SELECT page_id, group_id, coalesce(string_agg(text, ' ' ORDER BY band, x, region_id) FILTER (ok), '') AS text, coalesce(round(sum(score * greatest(1, length(text))) FILTER (ok) / sum(greatest(1, length(text))) FILTER (ok), 6), 0.0::DOUBLE) AS confidence FROM (SELECT *, score >= 0.35 AND text <> '' AS ok FROM l) GROUP BY ALL""",
}

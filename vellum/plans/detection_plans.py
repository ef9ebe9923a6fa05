"""Queries over what detectors and readers return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import detections as D
from ..operators import service
from ..operators.routing import best_bubble
from ..sources import fixtures as fx
from .fixture_sql import BUBBLES, PLACED, REGIONS, RESPONSES, TEXTS, cnt, strip
from .text_plans import FRAGMENT, SOUND

BOX = ("x1", "y1", "x2", "y2")
KEY = ("page_id", "region_id")


def _flat(df, name: str = "r"):
    return df.select(*KEY, *[F.col(f"{name}.{c}").alias(c) for c in BOX])


def _found(spark, d):
    r = fx.regions(spark, d)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    found = r.select(*KEY, (F.col("x1") * 1.5 - 40).alias("cx"), (F.col("y1") * 1.0 - 30).alias("cy"), w.alias("w"), h.alias("h"), "score", "img_w", "img_h")
    return D.detector_boxes(found)


def _pixels(spark, d):
    li = fx.table(spark, d, "lineitem")
    key = F.col("l_suppkey")
    return li.select(key.alias("page_id"), (F.col("l_linenumber") % 2).cast("int").alias("bubble_id"), (F.col("l_partkey") % (20 + key % 60)).cast("int").alias("x"), (F.col("l_orderkey") % (30 + key % 97)).cast("int").alias("y"), (F.lit(255) - (F.col("l_quantity").cast("int") * 3) % (60 + key % 90)).cast("int").alias("gray"))


def _lines(spark, d):
    return fx.placed(fx.regions(spark, d), fx.texts(spark, d))


def _layout(spark, d):
    return best_bubble(fx.regions(spark, d), fx.bubbles(spark, d))


def _green(spark, d):
    b = fx.bubbles(spark, d).select("page_id", F.col("bubble_id").alias("bubble_idx"), G.of().alias("bubble"))
    green = G.box(F.col("x1") - F.col("txt_len") % 30, F.col("y1") + 7, F.col("x2") + F.col("txt_len") % 20, F.col("y2") - 5)
    df = _layout(spark, d).join(b, ["page_id", "bubble_idx"], "left").withColumn("r", D.green_box(G.of(), green, F.col("bubble")))
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    df = df.withColumn("p", D.within(points, F.col("r")))
    return df.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in BOX], F.col("p")[0]["x"].alias("px"), F.col("p")[2]["y"].alias("py"))


def _repair(spark, d):
    r = fx.regions(spark, d)
    extra = F.when(F.col("txt_len") % 3 > 0, G.box(F.col("x1") - 9, F.col("y1") + 4, F.col("x2") + F.col("txt_len") * 4, F.col("y2") + 60))
    df = r.withColumn("r", D.repair_box(G.of(), extra, F.col("img_w"), F.col("img_h")))
    return df.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in BOX], D.repair_pad(F.col("r")).alias("pad"))


def _shown(spark, d):
    small = G.box(F.col("x1"), F.col("y1"), F.col("x1") + F.col("txt_len") % 25, F.col("y2"))
    df = fx.regions(spark, d).withColumn("r", D.shown_box(small, F.lit(0.75), F.lit(1.25), F.col("img_w"), F.col("img_h")))
    return _flat(df.where("r is not null"))


def _crop(spark, d):
    r = fx.regions(spark, d)
    ratio = F.when(F.col("txt_len") % 4 == 0, F.lit(0.0)).otherwise(F.lit(1.25))
    c = D.snapshot_crop(F.col("x1") - 50, F.when(F.col("txt_len") % 5 > 0, F.col("y1")), F.col("x2") - F.col("x1") - 60, F.col("y2") - F.col("y1"), F.lit(1.5), ratio)
    return r.select(*KEY, c.alias("c")).select(*KEY, "c.*")


def _cleaned(spark, d):
    r = fx.regions(spark, d).where("txt_len % 4 > 0")
    reason = F.element_at(F.array(F.lit("device_overlay_required"), F.lit("source_cover_required"), F.lit("art"), F.lit(None).cast("string")), (F.col("txt_len") % 5 % 4 + 1).cast("int"))
    status = r.select(*KEY, F.when(F.col("txt_len") % 7 > 0, F.col("txt_len") % 3 == 0).alias("cleaned"), reason.alias("reason"))
    return D.with_cleanup(_layout(spark, d), status).select(*KEY, "cleanup", "reason")


def _names(spark, d):
    names = F.array(*map(F.lit, ("Page_ZH_1", "external_zh9", "modern_ko", "runtime_ko_x", "a_ko_b", "my_runtime_zh", "ja_page")))
    return fx.table(spark, d, "events").select("event_id", D.sample_language(F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("language"), D.cents((F.col("event_id") % 4001 - 2000) / 1000.0).alias("cents"))


def _blocked(spark, d):
    return fx.table(spark, d, "nation").select("n_nationkey", D.access_blocked(F.slice(F.array(F.lit(401), F.lit(403), F.when(F.col("n_nationkey") % 2 == 0, 401).otherwise(500)), F.lit(1), (F.col("n_nationkey") % 4).cast("int"))).alias("blocked"))


def _restored(spark, d):
    e = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("server"), "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5).alias("used"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).otherwise("").alias("image"))
    return D.restored(e, "server", "used", "o_orderkey", "image").select("server", "o_orderkey", "age")


def _attempts(spark, d):
    o = fx.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("provider"), F.col("o_orderkey").alias("page_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    kind = F.when((F.col("page_id") + F.col("attempt")) % 7 < 3, "accepted").when(((F.col("page_id") * 3 + F.col("attempt")) % 5 > 1) & ((F.col("attempt") < 3) | (F.col("page_id") % 11 == 0)), "error").otherwise("empty")
    return service.provider_attempts(o.withColumn("outcome", kind), "provider", "page_id", "attempt", "outcome").select("page_id", "attempt", "made", "wait_ms", "disables")


def _erased(spark, d):
    pale, dark = (F.col("page_id") * 7 % 10) / 20.0, (F.col("region_id") * 3 % 10) / 40.0
    return fx.texts(spark, d).select(*KEY, T.erase_only(F.col("text"), (F.lit(20) + F.col("page_id") % 60).cast("int"), (F.lit(40) + F.col("region_id") % 50).cast("int"), pale, dark).alias("erased"))


QUERIES = {
    "provider_attempts": _attempts,
    "erase_only": _erased,
    "detector_boxes": _found,
    "bubble_filter": lambda spark, d: D.valid_bubbles(_pixels(spark, d), "page_id", "bubble_id").select("page_id", "bubble_id", "n", F.round("white", 6).alias("white"), F.round("mean", 6).alias("mean")),
    "han_lines": lambda spark, d: D.han_lines(_lines(spark, d)).select(*KEY, "text", *BOX),
    "korean_lines": lambda spark, d: D.korean_lines(_lines(spark, d).withColumn("pass", F.when(F.col("txt_len") % 2 == 0, "ko").otherwise("ch"))).select(*KEY, "text", *BOX),
    "raw_unions": lambda spark, d: D.raw_unions(fx.regions(spark, d), fx.bubbles(spark, d)),
    "green_box": _green,
    "repair_box": _repair,
    "shown_box": _shown,
    "snapshot_crop": _crop,
    "translated_layout": lambda spark, d: D.with_translation(fx.regions(spark, d), fx.responses(spark, d)).select(*KEY),
    "layout_cleanup": _cleaned,
    "small_rules": _names,
    "access_blocked": _blocked,
    "placeholder_stripped": lambda spark, d: fx.responses(spark, d).select(*KEY, "provider", D.without_placeholder(F.when(F.col("region_id") % 3 == 0, F.concat(F.lit("[TL: "), "en_text", F.lit("]"))).otherwise(F.col("en_text"))).alias("said")),
    "lru_restore": _restored,
}

_INT = "CAST(trunc({}) AS INT)".format
_LINES = f"{REGIONS}, {TEXTS}, {PLACED.format(boxes='fx_regions')}, l AS (SELECT *, {strip('text')} AS said FROM placed)"
_ROUTED = f"""{REGIONS}, {BUBBLES}, met AS (SELECT r.page_id, r.region_id, b.bubble_id, greatest(0, least(r.x2, b.x2) - greatest(r.x1, b.x1)) * greatest(0, least(r.y2, b.y2) - greatest(r.y1, b.y1)) / greatest(1, (r.x2 - r.x1) * (r.y2 - r.y1))::DOUBLE AS share FROM fx_regions r JOIN fx_bubbles b USING (page_id)),
best AS (SELECT page_id, region_id, arg_max(bubble_id, {{'s': share, 'b': -bubble_id}}) AS bubble_idx FROM met WHERE share >= 0.18 GROUP BY ALL),
lay AS (SELECT r.*, coalesce(best.bubble_idx, -1) AS bubble_idx FROM fx_regions r LEFT JOIN best USING (page_id, region_id))"""
_GROWN = "greatest(0, x1 - {0}) AS x1, greatest(0, y1 - {0}) AS y1, least(img_w, x2 + {0}) AS x2, least(img_h, y2 + {0}) AS y2".format
_SAID = "CASE WHEN region_id % 3 = 0 THEN concat('[TL: ', en_text, ']') ELSE en_text END"

SQL = {
    "provider_attempts": """WITH o AS (SELECT o_custkey % 40 AS provider, o_orderkey AS page_id, CAST(unnest([1, 2, 3]) AS INT) AS attempt FROM orders),
a AS (SELECT *, CASE WHEN (page_id + attempt) % 7 < 3 THEN 'accepted' WHEN (page_id * 3 + attempt) % 5 > 1 AND (attempt < 3 OR page_id % 11 = 0) THEN 'error' ELSE 'empty' END AS outcome FROM o),
b AS (SELECT *, NOT EXISTS (SELECT 1 FROM a e WHERE e.page_id = a.page_id AND e.attempt < a.attempt AND e.outcome = 'accepted') AS alone FROM a),
c AS (SELECT provider, min(page_id) AS ended FROM b WHERE alone AND attempt = 3 AND outcome = 'error' GROUP BY provider),
m AS (SELECT b.*, alone AND (ended IS NULL OR page_id <= ended) AS made FROM b LEFT JOIN c USING (provider))
SELECT page_id, attempt, made, CASE WHEN made AND outcome = 'error' AND attempt < 3 THEN least(4000, attempt * 1500) ELSE 0 END AS wait_ms, made AND outcome = 'error' AND attempt = 3 AS disables FROM m""",
    "erase_only": f"WITH {TEXTS} SELECT page_id, region_id, NOT {SOUND} AND {cnt('text', T.HAN)} + {cnt('text', T.HANGUL)} = 0 AND {cnt('text', T.KANA)} >= 2 AND length({FRAGMENT}) <= 4 AND 20 + page_id % 60 <= greatest(42, CAST(trunc((40 + region_id % 50) * 0.74::DOUBLE) AS INT)) AND ((page_id * 7 % 10) / 20.0::DOUBLE >= 0.34 OR (region_id * 3 % 10) / 40.0::DOUBLE >= 0.16) AS erased FROM fx_texts",
    "detector_boxes": f"""WITH {REGIONS}, c AS (SELECT *, x1 * 1.5::DOUBLE - 40 AS cx, y1 * 1.0::DOUBLE - 30 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM fx_regions WHERE score > 0.05),
b AS (SELECT page_id, region_id, {_INT('greatest(0, (cx - w / 2) * 0.78125::DOUBLE)')} AS x1, {_INT('greatest(0, (cy - h / 2) * 1.171875::DOUBLE)')} AS y1, {_INT('least(800, (cx + w / 2) * 0.78125::DOUBLE)')} AS x2, {_INT('least(1200, (cy + h / 2) * 1.171875::DOUBLE)')} AS y2, score FROM c)
SELECT * FROM b WHERE x2 > x1 AND y2 > y1""",
    "bubble_filter": """WITH p AS (SELECT l_suppkey AS page_id, CAST(l_linenumber % 2 AS INT) AS bubble_id, l_partkey % (20 + l_suppkey % 60) AS x, l_orderkey % (30 + l_suppkey % 97) AS y, 255 - (CAST(l_quantity AS INT) * 3) % (60 + l_suppkey % 90) AS gray FROM lineitem),
m AS (SELECT page_id, bubble_id, count(*) AS n, avg(CASE WHEN gray > 200 THEN 1.0::DOUBLE ELSE 0 END) AS white, avg(gray) AS mean, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM p GROUP BY ALL)
SELECT page_id, bubble_id, n, round(white, 6) AS white, round(mean, 6) AS mean FROM m WHERE n >= 200 AND white >= 0.7 AND NOT (h > w * 2.5 AND n < 5000) AND mean >= 180""",
    "han_lines": f"""WITH {_LINES}, g AS (SELECT page_id, region_id, said AS text, {_GROWN(3)} FROM l WHERE score >= 0.42 AND {cnt('said', T.HAN)} > 0)
SELECT * FROM g WHERE x2 - x1 >= 6 AND y2 - y1 >= 6 AND (x2 - x1) * (y2 - y1) >= 45 QUALIFY row_number() OVER (PARTITION BY page_id, text, x1 // 5, y1 // 5, x2 // 5, y2 // 5 ORDER BY region_id) = 1""",
    "korean_lines": f"""WITH {_LINES}, s AS (SELECT *, {cnt('said', T.HANGUL_WIDE)} AS ko, {cnt('said', T.HAN)} AS han FROM l),
g AS (SELECT page_id, region_id, said AS text, {_GROWN(4)} FROM s WHERE CASE WHEN txt_len % 2 = 0 THEN (ko >= 2 AND score >= 0.5) OR (ko = 1 AND score >= 0.08) ELSE han >= 2 AND score >= 0.65 END)
SELECT * FROM g WHERE x2 - x1 >= 8 AND y2 - y1 >= 8""",
    "raw_unions": f"""WITH {REGIONS}, {BUBBLES}, u AS (SELECT page_id, greatest(0, min(x1) - 14) AS x1, greatest(0, min(y1) - 14) AS y1, least(800, max(x2) + 14) AS x2, least(1200, max(y2) + 14) AS y2 FROM fx_regions WHERE (x2 - x1) * (y2 - y1) >= 80 AND x2 - x1 >= 5 AND y2 - y1 >= 5 GROUP BY page_id),
m AS (SELECT u.page_id, b.bubble_id, b.x1, b.y1, b.x2, b.y2, greatest(0, least(u.x2, b.x2) - greatest(u.x1, b.x1)) * greatest(0, least(u.y2, b.y2) - greatest(u.y1, b.y1)) / greatest(1, (u.x2 - u.x1) * (u.y2 - u.y1))::DOUBLE AS share FROM u JOIN fx_bubbles b USING (page_id)),
f AS (SELECT * FROM m WHERE share >= 0.18 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY share DESC, bubble_id) = 1)
SELECT u.page_id, coalesce(f.bubble_id, -1) AS bubble_idx, CASE WHEN f.bubble_id IS NULL THEN 'floating_dialogue' ELSE 'bubble_dialogue' END AS route, CASE WHEN f.bubble_id IS NULL THEN 'stroke' ELSE 'bubble_interior' END AS mask_mode,
  coalesce(f.x1 + greatest(2, {_INT('(f.x2 - f.x1) * 0.04::DOUBLE')}), 24) AS x1, coalesce(f.y1 + greatest(2, {_INT('(f.y2 - f.y1) * 0.04::DOUBLE')}), 36) AS y1, coalesce(f.x2 - greatest(2, {_INT('(f.x2 - f.x1) * 0.04::DOUBLE')}), 776) AS x2, coalesce(f.y2 - greatest(2, {_INT('(f.y2 - f.y1) * 0.04::DOUBLE')}), 1164) AS y2 FROM u LEFT JOIN f USING (page_id)""",
    "green_box": f"""WITH {_ROUTED}, g AS (SELECT l.page_id, l.region_id, l.x1 AS ox1, l.y2 AS oy2,
  greatest(least(l.x1 - txt_len % 30, {_INT('l.x1 - greatest(1, (l.x2 - l.x1) * 0.005::DOUBLE)')}), b.x1 + greatest(1, {_INT('(b.x2 - b.x1) * 0.05::DOUBLE')})) AS x1, greatest(least(l.y1 + 7, {_INT('l.y1 - greatest(1, (l.y2 - l.y1) * 0.005::DOUBLE)')}), b.y1 + greatest(1, {_INT('(b.y2 - b.y1) * 0.05::DOUBLE')})) AS y1,
  least(greatest(l.x2 + txt_len % 20, {_INT('l.x2 + greatest(1, (l.x2 - l.x1) * 0.005::DOUBLE)')}), b.x2 - greatest(1, {_INT('(b.x2 - b.x1) * 0.05::DOUBLE')})) AS x2, least(greatest(l.y2 - 5, {_INT('l.y2 + greatest(1, (l.y2 - l.y1) * 0.005::DOUBLE)')}), b.y2 - greatest(1, {_INT('(b.y2 - b.y1) * 0.05::DOUBLE')})) AS y2
FROM lay l LEFT JOIN fx_bubbles b ON b.page_id = l.page_id AND b.bubble_id = l.bubble_idx) SELECT page_id, region_id, x1, y1, x2, y2, greatest(x1, least(x2, ox1)) AS px, greatest(y1, least(y2, oy2)) AS py FROM g""",
    "repair_box": f"""WITH {REGIONS}, g AS (SELECT page_id, region_id, greatest(0, least(800, CASE WHEN txt_len % 3 > 0 THEN x1 - 9 ELSE x1 END)) AS x1, greatest(0, least(1200, y1)) AS y1, greatest(0, least(800, CASE WHEN txt_len % 3 > 0 THEN x2 + txt_len * 4 ELSE x2 END)) AS x2, greatest(0, least(1200, CASE WHEN txt_len % 3 > 0 THEN y2 + 60 ELSE y2 END)) AS y2 FROM fx_regions)
SELECT *, CASE WHEN x2 - x1 <= 180 AND y2 - y1 <= 120 THEN 6 ELSE 2 END AS pad FROM g""",
    "shown_box": f"""WITH {REGIONS}, g AS (SELECT page_id, region_id, greatest(0, CAST(floor(x1 * 0.75) AS INT) - 2) AS x1, greatest(0, CAST(floor(y1 * 1.25) AS INT) - 2) AS y1, least(800, CAST(ceil((x1 + txt_len % 25) * 0.75) AS INT) + 2) AS x2, least(1200, CAST(ceil(y2 * 1.25) AS INT) + 2) AS y2 FROM fx_regions) SELECT * FROM g WHERE x2 - x1 >= 8 AND y2 - y1 >= 8""",
    "snapshot_crop": f"""WITH {REGIONS}, s AS (SELECT *, 1.5::DOUBLE * CASE WHEN txt_len % 4 = 0 THEN 1 ELSE 1.25::DOUBLE END AS k FROM fx_regions) SELECT page_id, region_id, greatest(0, CAST(floor((x1 - 50) * k + 0.5) AS INT)) AS x, greatest(0, CAST(floor(CASE WHEN txt_len % 5 > 0 THEN y1 ELSE 0 END * k + 0.5) AS INT)) AS y, greatest(1, CAST(floor((x2 - x1 - 60) * k + 0.5) AS INT)) AS w, greatest(1, CAST(floor((y2 - y1) * k + 0.5) AS INT)) AS h FROM s""",
    "translated_layout": f"""WITH {REGIONS}, {RESPONSES} SELECT page_id, region_id FROM fx_regions r WHERE EXISTS (SELECT 1 FROM fx_responses a WHERE a.page_id = r.page_id AND a.region_id = r.region_id AND {strip('en_text')} <> '' AND NOT starts_with({strip('en_text')}, '[TL:') AND regexp_matches(en_text, '[\\p{{L}}\\p{{N}}]'))""",
    "layout_cleanup": f"""WITH {_ROUTED}, s AS (SELECT page_id, region_id, CASE WHEN bubble_idx = -1 AND txt_len % 4 > 0 AND txt_len % 7 > 0 AND txt_len % 3 <> 0 THEN CASE txt_len % 5 % 4 WHEN 0 THEN 'device_overlay_required' WHEN 1 THEN 'source_cover_required' WHEN 2 THEN 'art' ELSE 'unsafe_art_preserved' END END AS reason FROM lay)
SELECT page_id, region_id, CASE WHEN reason IS NULL THEN 'draw' WHEN reason = 'device_overlay_required' THEN 'badge' WHEN reason = 'source_cover_required' THEN 'cover' ELSE 'skip' END AS cleanup, reason FROM s""",
    "small_rules": "WITH e AS (SELECT event_id, (event_id % 4001 - 2000) / 1000.0::DOUBLE AS v FROM events) SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ch_tra' WHEN 1 THEN 'ch_tra' WHEN 2 THEN 'ko' WHEN 3 THEN 'ko' WHEN 4 THEN 'ko' END AS language, floor(CAST(printf('%.14e', abs(v) * 100) AS DOUBLE) + 0.5) / 100 * sign(v) AS cents FROM e",
    "access_blocked": "SELECT n_nationkey, n_nationkey % 4 <> 0 AND (n_nationkey % 4 <> 3 OR n_nationkey % 2 = 0) AS blocked FROM nation",
    "placeholder_stripped": f"WITH {RESPONSES}, s AS (SELECT page_id, region_id, provider, {_SAID} AS t FROM fx_responses) SELECT page_id, region_id, provider, CASE WHEN starts_with(t, '[TL:') THEN split_part(replace(replace(t, '[TL: ', ''), ']', ''), '...', 1) ELSE t END AS said FROM s",
    "lru_restore": "SELECT o_custkey AS server, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 ELSE 0 END, o_orderkey) AS INT) AS age FROM orders WHERE o_orderkey % 4 > 0 AND o_orderstatus <> ''",
}

"""Queries over cleanup decisions and small service rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import cleanup, service
from ..sources import fixtures as fx
from .fixture_sql import REGIONS


def _with_green(spark, d):
    """Regions with a layout box that leans on the next numbers."""
    r = fx.regions(spark, d).withColumn("red", G.of())
    green = G.box(F.col("x1") - F.col("txt_len") % 30, F.col("y1") - 7, F.col("x2") + F.col("txt_len") % 20, F.col("y2") + 5)
    return r.withColumn("green", green)


def _spread(make):
    return lambda spark, d: _with_green(spark, d).withColumn("r", make(F.col("red"), F.col("green"), F.col("img_w"), F.col("img_h"))).select("page_id", "region_id", *[F.col(f"r.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _erase(spark, d):
    own = F.transform(F.sort_array(F.collect_list(F.struct("region_id", "red"))), lambda e: e["red"])
    pages = fx.regions(spark, d).withColumn("red", G.of()).groupBy("page_id").agg(own.alias("boxes"))
    found = pages.select("page_id", cleanup.erase_boxes(F.element_at("boxes", 1), F.slice("boxes", F.lit(2), F.size("boxes")), F.lit(fx.IMG_W), F.lit(fx.IMG_H)).alias("e"))
    return found.select("page_id", F.posexplode("e").alias("place", "b")).select("page_id", "place", "b.*")


def _gates(spark, d):
    c = lambda k, m: (F.pmod(F.col("page_id") * k + F.col("region_id") * 31, F.lit(m)) / m).cast("double")
    bad = cleanup.unsafe(F.lit(1.0) - c(7, 29) / 3, F.lit(1.0) - c(11, 17) / 2, c(3, 13) / 5, c(5, 19) / 12, c(13, 23) / 10, c(17, 31) / 12, c(19, 37) * 40)
    return fx.regions(spark, d).select("page_id", "region_id", bad.alias("unsafe"), cleanup.text_style(c(3, 13) * 255, c(3, 13) * 255 + 20, c(5, 19)).alias("style"))


def _rows(spark, d):
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), (F.dayofyear("l_shipdate")).alias("row")).agg(F.max("l_quantity").alias("v"))


QUERIES = {
    "cleanup_box": _spread(cleanup.cleanup_box),
    "overlay_box": _spread(cleanup.overlay_box),
    "erase_boxes": _erase,
    "cleanup_gate": _gates,
    "row_band": lambda spark, d: cleanup.row_band(_rows(spark, d), "key", "row", "v", 10).select("key", "row", "band"),
    "carry_forward": lambda spark, d: cleanup.carried(_rows(spark, d).withColumn("v", F.when(F.col("v") > 30, F.col("v"))), "key", "row", "v").select("key", "row", "carried"),
    "scrub_secret": lambda spark, d: fx.table(spark, d, "events").select("event_id", T.scrubbed(F.concat(F.lit("GET /x?key=abc"), F.col("event_id").cast("string"), F.lit("&a=1 Bearer  t.o-k_"), "event_type", F.lit(" failed"))).alias("said")),
    "health_url": lambda spark, d: fx.table(spark, d, "events").select("event_id", T.health_url(F.element_at(F.array(*map(F.lit, ("http://h:8766/v1/translate-image?x=1#y", "https://h/p/v1/translate-snapshot", "http://h/translate", "none", "http://h", "http://h/translate-image"))), (F.col("event_id") % 6 + 1).cast("int"))).alias("url")),
    "key_rotation": lambda spark, d: fx.table(spark, d, "nation").select("n_nationkey", F.array_join(service.key_order(F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (F.col("n_nationkey") % 5)), F.col("n_nationkey"), F.array(F.col("n_nationkey") % 3)), ",").alias("places")),
    "lookup_state": lambda spark, d: service.lookup(fx.table(spark, d, "orders").select("o_orderkey", "o_custkey"), fx.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), fx.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "state"),
}

_G = f"{REGIONS}, g AS (SELECT *, x1 - txt_len % 30 AS gx1, y1 - 7 AS gy1, x2 + txt_len % 20 AS gx2, y2 + 5 AS gy2 FROM fx_regions)"
_TALL = "(y2 - y1 >= (x2 - x1) * 1.35::DOUBLE AND x2 - x1 <= 180 AND greatest(1, (gx2 - gx1) * (gy2 - gy1)) <= greatest(1, (x2 - x1) * (y2 - y1)) * 2.4::DOUBLE)"
_DX = "least(greatest(28, CAST(trunc(greatest(gx2 - gx1, x2 - x1) * 0.32::DOUBLE) AS INT)), 128)"
_DY = "least(greatest(16, CAST(trunc(greatest(gy2 - gy1, y2 - y1) * 0.16::DOUBLE) AS INT)), 96)"


def _c(k: int, m: int) -> str:
    return f"(((page_id * {k} + region_id * 31) % {m}) / {m})"


_ROWS = "r AS (SELECT l_suppkey AS key, CAST(dayofyear(l_shipdate) AS INT) AS row, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"

SQL = {
    "cleanup_box": f"WITH {_G} SELECT page_id, region_id, CASE WHEN {_TALL} THEN greatest(0, least(x1, gx1)) ELSE x1 END AS x1, CASE WHEN {_TALL} THEN greatest(0, least(y1, gy1)) ELSE y1 END AS y1, CASE WHEN {_TALL} THEN least(800, greatest(x2, gx2)) ELSE x2 END AS x2, CASE WHEN {_TALL} THEN least(1200, greatest(y2, gy2)) ELSE y2 END AS y2 FROM g",
    "overlay_box": f"WITH {_G} SELECT page_id, region_id, greatest(0, least(x1, gx1) - {_DX}) AS x1, greatest(0, least(y1, gy1) - {_DY}) AS y1, least(800, greatest(x2, gx2) + {_DX}) AS x2, least(1200, greatest(y2, gy2) + {_DY}) AS y2 FROM g",
    "erase_boxes": f"""WITH {REGIONS}, b AS (SELECT page_id, region_id, count(*) OVER (PARTITION BY page_id) AS n, greatest(0, x1 - 1) AS x1, greatest(0, y1 - 1) AS y1, least(800, x2 + 1) AS x2, least(1200, y2 + 1) AS y2 FROM fx_regions),
k AS (SELECT b.*, b.region_id = 0 OR NOT (b.x1 >= p.x1 - 2 AND b.y1 >= p.y1 - 2 AND b.x2 <= p.x2 + 2 AND b.y2 <= p.y2 + 2) AS stays FROM b JOIN b p ON p.page_id = b.page_id AND p.region_id = 0 WHERE b.n > 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY region_id) - 1 AS INT) AS place, x1, y1, x2, y2 FROM k WHERE stays""",
    "cleanup_gate": f"""WITH {REGIONS}, s AS (SELECT page_id, region_id, 1.0::DOUBLE - {_c(7, 29)} / 3 AS paper, 1.0::DOUBLE - {_c(11, 17)} / 2 AS dark, {_c(3, 13)} / 5 AS e, {_c(5, 19)} / 12 AS ne, {_c(13, 23)} / 10 AS oe, {_c(17, 31)} / 12 AS od, {_c(19, 37)} * 40 AS sd, {_c(3, 13)} * 255 AS m, {_c(5, 19)} AS df FROM fx_regions)
SELECT page_id, region_id, NOT ((paper >= 0.86 AND ne <= 0.035 AND od <= 0.055 AND e <= 0.16) OR (dark >= 0.72 AND ne <= 0.045 AND oe <= 0.06 AND sd <= 32) OR (paper >= 0.72 AND ne <= 0.025 AND od <= 0.04 AND e <= 0.075 AND sd <= 18)) AS unsafe,
  CASE WHEN (m < 90 AND m + 20 < 130) OR df >= 0.38 THEN 'light_on_dark' ELSE 'dark_on_light' END AS style FROM s""",
    "row_band": f"WITH {_ROWS} SELECT key, row, quantile_cont(v, 0.5) OVER (PARTITION BY key ORDER BY row RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS band FROM r",
    "carry_forward": f"WITH {_ROWS} SELECT key, row, last_value(CASE WHEN v > 30 THEN v END IGNORE NULLS) OVER (PARTITION BY key ORDER BY row ROWS UNBOUNDED PRECEDING) AS carried FROM r",
    "scrub_secret": "SELECT event_id, 'GET /x?key=[REDACTED]&a=1 Bearer [REDACTED] failed' AS said FROM events",
    "health_url": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'http://h:8766/v1/health' WHEN 1 THEN 'https://h/p/v1/health' WHEN 2 THEN 'http://h/v1/health' WHEN 3 THEN 'http://127.0.0.1:8766/v1/health' WHEN 4 THEN 'http://h/v1/health' ELSE 'http://h/translate-image' END AS url FROM events",
    "key_rotation": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE array_to_string(list_filter(list_transform(range(0, n_nationkey % 5), lambda i: (n_nationkey + i) % (n_nationkey % 5) + 1), lambda p: p <> n_nationkey % 3), ',') END AS places FROM nation",
    "lookup_state": "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c_acctbal > 5000) THEN 'hit' WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c_acctbal < 0) THEN 'in_flight' ELSE 'miss' END AS state FROM orders",
}

"""Queries over sources, rasters and streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import pixels
from ..sources import fixtures as fx
from ..sources import io
from ..streaming import cache
from .service_plans import SQL as SERVICE_SQL

SIDE = 24


def rasters(spark, d):
    """A small gray page for each supplier: (x*7 + y*13 + key*29) % 256."""

    def draw(batches):
        y, x = np.mgrid[:SIDE, :SIDE]
        for b in batches:
            keys = b.column("page_id").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([SIDE] * len(keys), pa.int32()), pa.array([SIDE] * len(keys), pa.int32()), pa.array([((x * 7 + y * 13 + k * 29) % 256).astype(np.uint8).tobytes() for k in keys], pa.binary())], names=["page_id", "w", "h", "pixels"])

    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id")).mapInArrow(draw, "page_id long, w int, h int, pixels binary")


def _stats(spark, d):
    r = pixels.region_statistics(rasters(spark, d))
    return r.select("page_id", *[F.round(c, 6).alias(c) for c in ("pale", "dark", "mean", "std")])


def _urls(spark, d):
    p = fx.table(spark, d, "pages")
    url = io.data_url(F.col("html").cast("binary"))
    bare = F.base64(F.col("html").cast("binary"))
    return p.select("page_id", F.length(url).alias("url_chars"), F.sha2(io.decode_data_url(F.when(F.col("page_id") % 2 == 0, url).otherwise(bare)), 256).alias("content_sha256"))


_TAGS = "concat(html, '<img class=\"a\" data-src=\"http://x/', page_id, '.png\" src=\"/spacer.gif\"><IMG src=\"/p', page_id, '.jpg\"><img data-src=\"lazy\" alt=\"none\">')"


def folder(spark) -> str:
    """A new folder for a stream's files in spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return f"{at.rstrip('/')}/vellum/stream-{uuid.uuid4().hex}"


def _stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    # a file source reads folders; the table is one file in a folder of tables
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _lru_stream(spark, d):
    keyed = _stream(spark, d).select("event_type", F.unix_millis("ts").alias("at"), "event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"))
    at = folder(spark)
    cache.run_once(cache.lru_hits(keyed, "event_type"), f"{at}/out", f"{at}/state")
    return spark.read.schema("event_id long, key string, hit boolean").parquet(f"{at}/out")


def _wanted(spark, d):
    k = lambda n: F.col("o_orderkey") % n
    o = fx.table(spark, d, "orders").select("o_orderkey", F.when(k(17) > 0, F.concat(F.lit("http://x/"), F.col("o_orderkey").cast("string"))).alias("src"), (k(5) > 0).alias("enabled"), (k(7) == 0).alias("forced"), F.when(k(3) > 0, k(11) == 0).alias("paused"), (k(13) == 0).alias("translated"), (k(19) == 0).alias("processing"), (k(23) == 0).alias("known"), (k(29) == 0).alias("pending"), (k(4) == 0).alias("inline"), (k(6) == 0).alias("replaced"), (k(8) == 0).alias("standalone"), (k(2) * (150 + k(101))).alias("natural_w"), (190 + k(37)).alias("natural_h"), (160 + k(83)).alias("width"), F.lit(0).alias("height"), (60 + k(97)).alias("shown_w"), (95 + k(41)).alias("shown_h"))
    return o.select("o_orderkey", io.wanted().alias("wanted"))


QUERIES = {
    "data_url": _urls,
    "content_key": lambda spark, d: fx.table(spark, d, "pages").select("page_id", io.page_key(F.lit("ja"), F.col("html").cast("binary")).alias("key")),
    "image_candidates": lambda spark, d: io.image_candidates(fx.table(spark, d, "pages").withColumn("html", F.expr(_TAGS))),
    "manifest": lambda spark, d: fx.table(spark, d, "nation").select("n_nationkey", io.manifest(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("json")),
    "latest_state": lambda spark, d: fx.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n")),
    "page_statistics": _stats,
    "raster_shapes": lambda spark, d: pixels.region_statistics(rasters(spark, d)).select("page_id", "n_components", "largest", "rectangle_area"),
    "wanted_images": _wanted,
    "lru_stream": _lru_stream,
}

_GRID = f"g AS (SELECT s_suppkey AS page_id, (x * 7 + y * 13 + s_suppkey * 29) % 256 AS v FROM supplier CROSS JOIN range({SIDE}) a(x) CROSS JOIN range({SIDE}) b(y))"

SQL = {
    "data_url": "SELECT page_id, CAST(length(to_base64(encode(html))) + 22 AS INT) AS url_chars, sha256(html) AS content_sha256 FROM pages",
    "content_key": "SELECT page_id, concat('runtime_ja_', left(sha1(html), 14)) AS key FROM pages",
    "image_candidates": f"""WITH t AS (SELECT page_id, regexp_extract_all({_TAGS}, '(?i)<img\\b[^>]*>') AS tags FROM pages), u AS (SELECT page_id, unnest(tags) AS tag, CAST(generate_subscripts(tags, 1) - 1 AS INT) AS place FROM t)
SELECT page_id, place, coalesce(CASE WHEN regexp_matches(regexp_extract(tag, '(?i)\\sdata-src="([^"]*)"', 1), '^(http|data:image/|file:)') THEN regexp_extract(tag, '(?i)\\sdata-src="([^"]*)"', 1) END, nullif(regexp_extract(tag, '(?i)\\ssrc="([^"]*)"', 1), '')) AS src FROM u WHERE src IS NOT NULL""",
    "manifest": "SELECT n_nationkey, CAST(to_json({'id': n_nationkey, 'name': n_name}) AS VARCHAR) AS json FROM nation",
    "latest_state": "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS state, count(*) AS n FROM events GROUP BY user_id",
    "page_statistics": f"WITH {_GRID} SELECT page_id, round(avg(CASE WHEN v > 168 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pale, round(avg(CASE WHEN v < 120 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dark, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM g GROUP BY page_id",
    "wanted_images": """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, (k % 5 > 0 OR k % 7 = 0) AND k % 17 > 0 AND NOT (k % 3 > 0 AND k % 11 = 0) AND k % 13 > 0 AND k % 19 > 0 AND k % 23 > 0 AND k % 29 > 0 AND NOT (k % 4 = 0 AND k % 6 = 0)
  AND CASE WHEN k % 2 = 0 THEN 160 + k % 83 ELSE 150 + k % 101 END >= 200 AND 190 + k % 37 >= 200 AND (k % 8 = 0 OR (60 + k % 97 >= 100 AND 95 + k % 41 >= 100)) AS wanted FROM o""",
    "lru_stream": SERVICE_SQL["lru_hits"],
}

"""Queries over request logs, type setting and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report, service, stats, typeset
from ..sources import fixtures as fx
from .fixture_sql import REGIONS, TEXTS, squeeze

DAY = 86_400_000


def _events(spark, d):
    """Events with milliseconds since the epoch, and a service time."""
    return fx.table(spark, d, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))


def _service():
    return F.floor(F.col("value") * 100).cast("long")


def _block():
    return F.floor(F.col("at") / DAY).cast("long")


def _lru(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return service.lru_hits(_events(spark, d), "event_type", key, "at", "event_id", _block())


def _fit(spark, d):
    r = fx.regions(spark, d).select("page_id", "region_id", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    t = fx.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return typeset.fitted(t.join(r, "page_id"), "text", "w", "h").select("page_id", "region_id", "font_size", "n_lines")


def _positions(spark, d):
    r = fx.regions(spark, d)
    return typeset.positions(r.select("page_id", "region_id", F.col("x1").alias("left"), F.col("y1").alias("top"), F.col("x2").alias("right"), F.col("y2").alias("bottom"), (F.lit(20) + F.col("page_id") % 50).cast("int").alias("bw"), (F.lit(10) + F.col("page_id") % 40).cast("int").alias("bh"), ((F.col("x1") + F.col("x2")) / 2).alias("ax"), (F.col("y1") + 30.0).alias("ay"), (F.col("x2") - 10.0).alias("gx"), ((F.col("y1") + F.col("y2")) / 2).alias("gy"))).select("page_id", "region_id", "x", "y")


def _misses(spark, d):
    o = fx.table(spark, d, "orders")
    requests = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_custkey") % 3 == 0, "ko").otherwise("ja").alias("language"))
    results = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "zh").when(F.col("o_custkey") % 3 == 0, "ko").otherwise("ja").alias("language"), F.when(F.col("o_orderkey") % 7 == 0, "fail").otherwise("pass").alias("status"), (F.lit(5) - (F.col("o_orderkey") % 11 == 0).cast("int")).alias("n_artifacts"), F.lit("v2").alias("cache_version"))
    return report.cache_misses(requests, results, "v2")


def _statuses(spark, d):
    names = F.array(*map(F.lit, ("fit", "clipped", "missing", "fit_with_word_split", "emergency")))
    return report.status_warnings(fx.regions(spark, d).select("page_id", F.element_at(names, ((F.col("page_id") + F.col("txt_len")) % 5 + 1).cast("int")).alias("status")))


QUERIES = {
    "queue_finish": lambda spark, d: service.queue_finish(_events(spark, d), "event_type", "at", "event_id", _service(), _block()).select("event_id", "finish"),
    "lru_hits": lambda spark, d: _lru(spark, d).select("event_id", "key", "hit"),
    "in_flight_join": lambda spark, d: service.in_flight(_events(spark, d), ["user_id", "event_type"], "at", "event_id", _service() * 20_000, _block()),
    "debounce": lambda spark, d: service.debounced(_events(spark, d), ["user_id"], "at", "event_id", 3 * DAY).select("event_id", "user_id"),
    "retry_schedule": lambda spark, d: service.retries(fx.table(spark, d, "events").select("event_id"), "event_id"),
    "negative_cache": lambda spark, d: service.negative_cache(_events(spark, d), ["user_id"], "at", "event_id", DAY).select("event_id", "known_miss"),
    "cache_miss": _misses,
    "status_warnings": _statuses,
    "wrap_lines": lambda spark, d: fx.texts(spark, d).select("page_id", "region_id", F.array_join(typeset.wrapped(F.col("text"), (F.lit(4) + F.col("page_id") % 9).cast("int")), "|").alias("lines")),
    "fit_font": _fit,
    "position_candidates": _positions,
    "layout_variants": lambda spark, d: fx.table(spark, d, "documents").select("doc_id", F.array_join(typeset.variants(F.col("text")), "|").alias("variants")),
    "text_metrics": lambda spark, d: fx.regions(spark, d).select("page_id", "region_id", typeset.outline(F.col("txt_len"), F.col("region_id") % 2 == 0).alias("outline"), typeset.line_spacing(F.col("txt_len")).alias("spacing")),
    "robust_inlier_centroid": lambda spark, d: stats.robust_centroid(fx.table(spark, d, "embeddings"), "label", "embedding", 1.0).select("label", "n_inliers", F.array_join(F.transform("centroid", lambda x: F.round(x, 5).cast("decimal(12,5)").cast("string")), ",").alias("centroid")),
    "mad_trim": lambda spark, d: stats.mad_trimmed(fx.table(spark, d, "lineitem"), F.col("l_partkey") % 50, "l_extendedprice", 500.0, 1.5).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean")),
    "plane_fit": lambda spark, d: stats.plane_fit(fx.table(spark, d, "lineitem"), "l_suppkey", F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_extendedprice") / 1000).select("l_suppkey", *[(F.round(c, 3) + 0.0).alias(c) for c in "abc"]),
}

_AT = "events_at AS (SELECT *, epoch_us(ts) // 1000 AS arrived, CAST(floor(value * 100) AS BIGINT) AS s FROM events)"
_WORDS = "string_split({t}, ' ')"


def _wrap_fold(words: str, w: str) -> str:
    """Lines of a list of words, as a fold over (lines, now)."""
    joined = "(CASE WHEN acc.now = '' THEN e.now ELSE concat(acc.now, ' ', e.now) END)"
    pushed = "(CASE WHEN acc.now = '' THEN acc.lines ELSE list_append(acc.lines, acc.now) END)"
    pieces = f"list_transform(range(0, (length(e.now) - 1) // {w} + 1), lambda i: substr(e.now, i * {w} + 1, {w}))"
    cut = f"{{'lines': list_concat({pushed}, list_slice({pieces}, 1, len({pieces}) - 1)), 'now': list_extract({pieces}, -1)}}"
    start = "{'lines': CAST([] AS VARCHAR[]), 'now': ''}"
    rows = f"list_prepend({start}, list_transform(list_filter({words}, lambda x: x <> ''), lambda x: {{'lines': CAST([] AS VARCHAR[]), 'now': x}}))"
    return f"list_reduce({rows}, lambda acc, e: CASE WHEN length({joined}) <= {w} THEN {{'lines': acc.lines, 'now': {joined}}} ELSE {cut} END)"


def _lines(fold: str) -> str:
    return f"(CASE WHEN {fold}.now <> '' THEN list_append({fold}.lines, {fold}.now) WHEN len({fold}.lines) = 0 THEN [''] ELSE {fold}.lines END)"


_AW, _AH = "greatest(1, w - 16)", "greatest(1, h - 16)"
_CLEAN = squeeze("text")


def _few(n: int) -> str:
    return f"CASE WHEN len(ws) <= {n} THEN c ELSE concat(regexp_replace(array_to_string(list_slice(ws, 1, {n}), ' '), '[.,;:]+$', ''), '...') END"


def _aside(lo: str, last: str, centre: str, size: str, off: str) -> str:
    return f"CAST(least(greatest(round_even({centre} + {off} - {size} / 2, 0), {lo}), {last}) AS INT)"


_NEAR = ", ".join(f"{{'x': {_aside('l', 'r - bw', cx, 'bw', f'({dx} * st)')}, 'y': {_aside('t', 'b - bh', cy, 'bh', f'({dy} * st)')}}}" for cx, cy in (("ax", "ay"), ("gx", "gy"), ("((l + r) / 2)", "((t + b) / 2)")) for dx, dy in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)))


def _axis(lo: str, hi: str, size: str) -> str:
    n = f"least(5, greatest(2, ({hi} - {lo}) // greatest(1, {size} // 2) + 1))"
    return f"list_transform(range(0, {n}), lambda i: CAST(round_even({lo} + i * (({hi} - {lo}) / ({n} - 1)), 0) AS INT))"


SQL = {
    "queue_finish": f"WITH {_AT} SELECT event_id, CAST(c + max(arrived - c + s) OVER w AS BIGINT) AS finish FROM (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY arrived, event_id) AS c FROM events_at) WINDOW w AS (PARTITION BY event_type ORDER BY arrived, event_id)",
    "lru_hits": f"""WITH {_AT}, n AS (SELECT event_id, event_type, concat_ws(':', user_id, event_type) AS key, row_number() OVER (PARTITION BY event_type ORDER BY arrived, event_id) AS i FROM events_at),
p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, key ORDER BY i) AS before FROM n)
SELECT event_id, key, before IS NOT NULL AND n < 12 AS hit FROM (SELECT a.event_id, a.key, a.before, count(DISTINCT b.key) AS n FROM p a LEFT JOIN p b ON a.event_type = b.event_type AND b.i > a.before AND b.i < a.i GROUP BY a.event_id, a.key, a.before)""",
    "in_flight_join": f"""WITH RECURSIVE {_AT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY arrived, event_id) AS i FROM events_at),
r AS (SELECT user_id, event_type, i, event_id, arrived + s * 20000 AS until, false AS joined FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_type, n.i, n.event_id, CASE WHEN n.arrived < r.until THEN r.until ELSE n.arrived + n.s * 20000 END, n.arrived < r.until FROM r JOIN n ON n.user_id = r.user_id AND n.event_type = r.event_type AND n.i = r.i + 1)
SELECT event_id, joined FROM r""",
    "debounce": f"WITH {_AT} SELECT event_id, user_id FROM (SELECT *, lead(arrived) OVER (PARTITION BY user_id ORDER BY arrived, event_id) AS n FROM events_at) WHERE n IS NULL OR n - arrived > {3 * DAY}",
    "retry_schedule": "SELECT event_id, CAST(n AS INT) AS attempt, CAST(3000 * (1 << (n - 1)) + (event_id * 7919 + n * 104729) % 1000 AS BIGINT) AS delay FROM events CROSS JOIN (VALUES (1), (2), (3)) t(n)",
    "negative_cache": f"WITH {_AT} SELECT event_id, coalesce(arrived - lag(arrived) OVER (PARTITION BY user_id ORDER BY arrived, event_id) < {DAY}, false) AS known_miss FROM events_at",
    "cache_miss": "SELECT o_orderkey AS key, CASE WHEN o_custkey % 3 = 0 THEN 'ko' ELSE 'ja' END AS language FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0",
    "status_warnings": f"WITH {REGIONS}, s AS (SELECT page_id, (page_id + txt_len) % 5 AS k FROM fx_regions) SELECT page_id, string_agg(DISTINCT CASE k WHEN 1 THEN 'clipped' WHEN 2 THEN 'missing' ELSE 'emergency' END, ',' ORDER BY CASE k WHEN 1 THEN 'clipped' WHEN 2 THEN 'missing' ELSE 'emergency' END) AS statuses FROM s WHERE k IN (1, 2, 4) GROUP BY page_id",
    "wrap_lines": f"WITH {TEXTS}, f AS (SELECT page_id, region_id, {_wrap_fold(_WORDS.format(t=squeeze('text')), 'CAST(4 + page_id % 9 AS INT)')} AS f FROM fx_texts) SELECT page_id, region_id, array_to_string({_lines('f')}, '|') AS lines FROM f",
    "fit_font": f"""WITH {REGIONS}, i AS (SELECT r.page_id, r.region_id, {_AW.replace("w", "(x2 - x1)", 1).replace("greatest(1, (x2 - x1)", "greatest(1, (x2 - x1)")} AS aw, {_AH.replace("h ", "(y2 - y1) ")} AS ah, string_split({squeeze("d.text")}, ' ') AS ws FROM fx_regions r JOIN documents d ON d.doc_id = r.page_id),
s AS (SELECT *, unnest(range(7, greatest(7, CAST(floor(least(ah * 0.48::DOUBLE, aw * 0.42::DOUBLE, 56)) AS INT)) + 1)) AS size FROM i), m AS (SELECT *, CAST(floor(aw / (size * 0.6::DOUBLE)) AS INT) AS chars FROM s),
f AS (SELECT *, {_wrap_fold("ws", "greatest(1, chars)")} AS f FROM m WHERE size = 7 OR floor(ah / ceil(size * 1.2::DOUBLE)) * (chars + 1) > length(array_to_string(ws, ' '))), n AS (SELECT page_id, region_id, size, chars, ah, len({_lines("f")}) AS n FROM f)
SELECT page_id, region_id, CAST(size AS INT) AS font_size, CAST(n AS INT) AS n_lines FROM n QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY CASE WHEN chars >= 1 AND n * ceil(size * 1.2::DOUBLE) <= ah THEN -size ELSE size END) = 1""",
    "position_candidates": f"""WITH {REGIONS}, k AS (SELECT page_id, region_id, x1 AS l, y1 AS t, x2 AS r, y2 AS b, CAST(20 + page_id % 50 AS INT) AS bw, CAST(10 + page_id % 40 AS INT) AS bh, (x1 + x2) / 2 AS ax, y1 + 30.0::DOUBLE AS ay, x2 - 10.0::DOUBLE AS gx, (y1 + y2) / 2 AS gy FROM fx_regions),
p AS (SELECT *, greatest(2, least(bw, bh) // 10) AS st FROM k WHERE r - bw >= l AND b - bh >= t),
a AS (SELECT page_id, region_id, [{_NEAR}] AS near, {_axis("l", "(r - bw)", "bw")} AS xs, {_axis("t", "(b - bh)", "bh")} AS ys FROM p),
u AS (SELECT page_id, region_id, unnest(near) AS q FROM a UNION ALL SELECT page_id, region_id, {{'x': x, 'y': y}} FROM (SELECT page_id, region_id, unnest(xs) AS x, ys FROM a), LATERAL (SELECT unnest(ys) AS y))
SELECT DISTINCT page_id, region_id, q.x AS x, q.y AS y FROM u""",
    "layout_variants": rf"""WITH v AS (SELECT doc_id, c, string_split(c, ' ') AS ws, regexp_replace(trim(regexp_replace(regexp_replace(c, '\([^)]{{1,80}}\)', '', 'g'), '\s+', ' ', 'g')), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS bare,
  coalesce(nullif(regexp_extract(c, '^(.*?[.!?])\s', 1), ''), c) AS sentence, trim(string_split_regex(c, '[,;:]\s+')[1]) AS clause FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)),
a AS (SELECT doc_id, c, list_filter([c, nullif(bare, ''), CASE WHEN length(sentence) >= 16 AND length(sentence) < length(c) THEN sentence END, CASE WHEN length(clause) >= 16 AND length(clause) < length(c) THEN clause END, {_few(16)}, {_few(12)}, {_few(9)}], lambda x: x IS NOT NULL) AS p FROM v)
SELECT doc_id, CASE WHEN c = '' THEN '' WHEN length(c) < 55 THEN c ELSE array_to_string(list_transform(list_filter(list_zip(p, range(0, len(p))), lambda x: list_position(p, x[1]) = x[2] + 1), lambda x: x[1]), '|') END AS variants FROM a""",
    "text_metrics": f"WITH {REGIONS} SELECT page_id, region_id, CAST(greatest(CASE WHEN region_id % 2 = 0 THEN 2 ELSE 1 END, least(3, round_even(txt_len * 0.06::DOUBLE, 0))) AS INT) AS outline, CAST(greatest(1, round_even(txt_len * 0.12::DOUBLE, 0)) AS INT) AS spacing FROM fx_regions",
    "robust_inlier_centroid": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, median(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL),
near AS (SELECT e.vec_id, e.label FROM e JOIN m USING (label, i) GROUP BY ALL HAVING sqrt(sum((CAST(x AS DOUBLE) - m) ** 2)) < 1.0),
c AS (SELECT e.label, i, median(CAST(x AS DOUBLE)) AS c FROM e JOIN near USING (vec_id, label) GROUP BY ALL)
SELECT c.label, any_value(n.n) AS n_inliers, string_agg(CAST(CAST(round(c, 5) AS DECIMAL(12, 5)) AS VARCHAR), ',' ORDER BY i) AS centroid FROM c JOIN (SELECT label, count(*) AS n FROM near GROUP BY label) n USING (label) GROUP BY c.label""",
    "mad_trim": "WITH r AS (SELECT l_partkey % 50 AS g, l_extendedprice AS v FROM lineitem), m AS (SELECT g, median(v) AS med FROM r GROUP BY g), d AS (SELECT r.*, med FROM r JOIN m USING (g)), k AS (SELECT g, median(abs(v - med)) + 1 AS mad FROM d GROUP BY g) SELECT g, count(*) AS n, round(avg(v), 4) AS mean FROM d JOIN k USING (g) WHERE abs(v - med) < greatest(500.0::DOUBLE, mad * 1.5::DOUBLE) GROUP BY g",
    "plane_fit": """WITH p AS (SELECT l_suppkey, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem), m AS (SELECT l_suppkey, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x*x) - avg(x)*avg(x) AS xx, avg(y*y) - avg(y)*avg(y) AS yy, avg(x*y) - avg(x)*avg(y) AS xy, avg(x*z) - avg(x)*avg(z) AS xz, avg(y*z) - avg(y)*avg(z) AS yz FROM p GROUP BY l_suppkey),
s AS (SELECT *, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS a, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS b FROM m) SELECT l_suppkey, round(a, 3) + 0.0::DOUBLE AS a, round(b, 3) + 0.0::DOUBLE AS b, round(mz - a*mx - b*my, 3) + 0.0::DOUBLE AS c FROM s""",
}

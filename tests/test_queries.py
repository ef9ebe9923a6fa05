"""Each query with SQL gives the rows of its SQL; the others are held against plain Python."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from vellum.operators import detections, grouping, layout, pixels, routing, service, stats
from vellum.plans.registry import ORACLE_SQL, QUERIES
from vellum.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == columns
    assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nms_is_maximal(spark):
    kept = {(r.page_id, r.region_id) for r in QUERIES["nms_keep"](spark, SF).collect()}
    pages = {}
    for r in fx.regions(spark, SF).collect():
        pages.setdefault(r.page_id, []).append(r)

    def iou(a, b):
        i = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
        return i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i + 1e-6)

    for rows in pages.values():
        out = []
        for r in sorted(rows, key=lambda r: (-r.score, r.region_id)):
            if all(iou(k, r) <= 0.45 for k in out):
                out.append(r)
        assert {r.region_id for r in rows if (r.page_id, r.region_id) in kept} == {r.region_id for r in out}


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def merged(boxes):
    """The rule itself: while there is a joint pair, the first in order becomes one box in the place of its first."""

    def joint(pair):
        a, b = boxes[pair[0]], boxes[pair[1]]
        side = range(max(a[0], b[0]), min(a[2], b[2]))
        gap = max(a[0], b[0]) - min(a[2], b[2]) if not side else 0
        rows = len(range(max(a[1], b[1]), min(a[3], b[3])))
        return gap < 25 and rows > 0.3 * min(a[3] - a[1], b[3] - b[1])

    boxes = list(map(tuple, boxes))
    while pair := next(filter(joint, itertools.combinations(range(len(boxes)), 2)), None):
        boxes[pair[0]] = union(boxes[pair[0]], boxes[pair[1]])
        boxes.pop(pair[1])
    return [list(b) for b in boxes]


def test_merge_boxes_follows_the_rule(spark):
    rng = random.Random(4)
    for _ in range(400):
        boxes = [[x, y, x + rng.randint(5, 60), y + rng.randint(5, 60)] for x, y in ((rng.randint(0, 300), rng.randint(0, 300)) for _ in range(rng.randint(0, 14)))]
        assert grouping.merge_boxes(boxes) == merged(boxes)
    by_page = {}
    for r in fx.regions(spark, SF).orderBy("page_id", "region_id").collect():
        by_page.setdefault(r.page_id, []).append([r.x1, r.y1, r.x2, r.y2])
    got = {}
    for r in QUERIES["box_merge_fixpoint"](spark, SF).orderBy("page_id", "box_id").collect():
        got.setdefault(r.page_id, []).append([r.x1, r.y1, r.x2, r.y2])
    assert got == {p: merged(b) for p, b in by_page.items()}


def test_recovery_keeps_accepted_items(spark):
    accepted = {(r.page_id, r.region_id) for r in QUERIES["layout_decision"](spark, SF).collect() if r.reason is None}
    rows = QUERIES["fragment_recovery"](spark, SF).collect()
    assert accepted <= {(r.page_id, int(m)) for r in rows for m in r.members.split(",")}
    assert len({(r.page_id, m) for r in rows for m in r.members.split(",")}) == sum(len(r.members.split(",")) for r in rows)


def test_recovery_follows_the_rules():
    """Hand-made pages: what each rule decides, at its limits."""
    item = lambda i, box, reason=None, bubble=-1, fragment=True, short=False: dict(zip(layout.BOX, box, strict=True), region_id=i, reason=reason, bubble_idx=bubble, fragment=fragment, short=short)
    found = lambda *items: {r["region_id"]: ([r[c] for c in layout.BOX], r["members"], r["source"]) for r in layout._recover(list(items))}
    column = item(0, (100, 100, 140, 200))
    merged_ = lambda box, ids: {0: (box, ids, "+".join(["adjacent_fragment_merged"] * (len(ids) - 1)))}
    alone = {0: ([100, 100, 140, 200], [0], None)}
    # int(100 * 1.15), 114 pixels apart, is the limit for two boxes of height 100
    assert found(column, item(1, (254, 100, 280, 200), "x")) == merged_([100, 100, 280, 200], [0, 1])
    assert found(column, item(1, (255, 100, 280, 200), "x")) == alone
    # no floating fragment, one in a bubble, none accepted
    assert found(column, item(1, (150, 100, 180, 200), "x", fragment=False)) == alone
    assert found(column, item(1, (150, 100, 180, 200), "x", bubble=3)) == alone
    assert found(item(1, (150, 100, 180, 200), "x")) == {}
    assert found(item(0, (100, 100, 140, 200), bubble=2), item(1, (150, 100, 180, 200), "x")) == {0: ([100, 100, 140, 200], [0], None)}
    # a short one becomes an item of its own, and later fragments meet it
    assert found(column, item(1, (240, 100, 280, 200), "x", short=True), item(2, (380, 100, 400, 200), "x")) == {**alone, 1: ([240, 100, 400, 200], [1, 2], "adjacent_short_dialogue+adjacent_fragment_merged")}
    # a grown box reaches further; a wide one is no column to stand beside
    assert found(item(0, (100, 100, 221, 200)), item(1, (230, 100, 250, 200), "x")) == {0: ([100, 100, 221, 200], [0], None)}
    # the nearest of two takes it, of equal ones the first
    near, far = item(5, (200, 100, 230, 200)), item(6, (300, 100, 330, 200))
    assert found(near, far, item(7, (240, 100, 280, 200), "x"))[5][1] == [5, 7]
    assert found(near, far, item(7, (240, 100, 290, 200), "x"))[5][1] == [5, 7]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = [(i, f"s{rng.randint(0, 2)}", f"k{min(rng.randint(0, 60), rng.randint(0, 60))}", rng.randint(0, 900_000), rng.randint(0, 2_000)) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "event_id long, server string, k string, at long, s long")


def test_queue_equals_simulation(spark, log):
    rows, df = log
    got = {r.event_id: r.finish for r in service.queue_finish(df, "server", "at", "event_id", df["s"], (df["at"] / 50_000).cast("long")).collect()}
    for server in {r[1] for r in rows}:
        end = 0
        for i, _, _, at, s in sorted((r for r in rows if r[1] == server), key=lambda r: (r[3], r[0])):
            end = max(end, at) + s
            assert got[i] == end


@pytest.mark.parametrize("limit", [1, 5, 12])
def test_lru_equals_simulation(spark, log, limit):
    rows, df = log
    got = {r.event_id: r.hit for r in service.lru_hits(df, "server", df["k"], "at", "event_id", (df["at"] / 50_000).cast("long"), limit).collect()}
    for server in {r[1] for r in rows}:
        keys = []
        for i, _, k, _, _ in sorted((r for r in rows if r[1] == server), key=lambda r: (r[3], r[0])):
            assert got[i] == (k in keys)
            keys = [k, *(x for x in keys if x != k)][:limit]


@pytest.mark.parametrize("width", [20_000, 2_000_000])
def test_in_flight_equals_simulation(spark, log, width):
    rows, _ = log
    rows = [(i, None if server == "s0" else server, k, at, s * (40 if k < "k2" else 1)) for i, server, k, at, s in rows] + [(5000 + i, "hot", "k", i // 3, 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, server string, k string, at long, s long")
    got = {r.event_id: r.joined for r in service.in_flight(df, ["server", "k"], "at", "event_id", df["s"], (df["at"] / width).cast("long")).collect()}
    assert len(got) == len(rows)
    end = {}
    for i, server, k, at, s in sorted(rows, key=lambda r: (r[3], r[0])):
        late = at < end.get((server, k), -1)
        assert got[i] == late
        end[server, k] = end[server, k] if late else at + s


def test_folds_of_empty_and_null_keys(spark):
    df = spark.createDataFrame([(1, None, None, 5, 9), (2, None, None, 6, 9), (3, None, "a", 7, 9)], "event_id long, server string, k string, at long, s long")
    assert {r.event_id: r.hit for r in service.lru_hits(df, "server", df["k"], "at", "event_id", df["at"]).collect()} == {1: False, 2: True, 3: False}
    assert {r.event_id: r.joined for r in service.in_flight(df, ["server", "k"], "at", "event_id", df["s"], df["at"]).collect()} == {1: False, 2: True, 3: False}
    none = df.where("event_id < 0")
    assert service.lru_hits(none, "server", none["k"], "at", "event_id", none["at"]).count() == 0
    assert service.in_flight(none, ["server"], "at", "event_id", none["s"], none["at"]).count() == 0


def test_detections_at_their_limits(spark):
    square = spark.createDataFrame([(1, i, 512.0, 512.0, w, 64.0, s, 512, 2048) for i, (w, s) in enumerate([(64.0, 0.05), (64.0, 0.0501), (1.0, 0.9), (4096.0, 0.9)])], "page_id long, region_id int, cx double, cy double, w double, h double, score double, img_w int, img_h int")
    assert {r.region_id: tuple(r)[2:6] for r in detections.detector_boxes(square).collect()} == {1: (240, 960, 272, 1088), 3: (0, 960, 512, 1088), 2: (255, 960, 256, 1088)}
    dots = [(1, x, y, 201 if x < 14 else 150) for x in range(20) for y in range(10)] + [(2, x, y, 255) for x in range(199) for y in range(1)] + [(3, x, y, 255) for x in range(10) for y in range(26)]
    kept = detections.valid_bubbles(spark.createDataFrame(dots, "m long, x int, y int, gray int"), "m").collect()
    assert [(r.m, r.n, r.white) for r in kept] == [(1, 200, 0.7)]
    tiny = spark.createDataFrame([(1, 0, 0, 0, 4, 99, 800, 1200), (2, 0, 100, 100, 110, 108, 800, 1200)], "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int, img_w int, img_h int")
    bubbles = spark.createDataFrame([(2, 7, 50, 50, 250, 150)], "page_id long, bubble_id int, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in detections.raw_unions(tiny, bubbles).collect()] == [(2, 7, "bubble_dialogue", "bubble_interior", 58, 54, 242, 146)]
    said = spark.createDataFrame([("[TL: one... two]",), ("[TL: one]",), ("one... two",), (None,)], "t string")
    assert [r[0] for r in said.select(detections.without_placeholder(said["t"])).collect()] == ["one", "one", "one... two", None]
    cents = spark.createDataFrame([(1.005,), (-1.005,), (2.345,), (0.0,)], "x double")
    assert [r[0] for r in cents.select(detections.cents(cents["x"])).collect()] == [1.01, -1.01, 2.35, 0.0]


def test_medians_are_exact(spark):
    rng = random.Random(3)
    groups = {"even": [rng.gauss(0, 1) for _ in range(5000)], "odd": [float(rng.randint(0, 3)) for _ in range(4001)], "one": [2.5], "two": [1.0, 4.0], "hot": [7.0] * 3000 + [8.0] * 2999 + [1.0], "three": [-1.0, 0.0, 9.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("one", math.nan), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    assert {r.g: r.m for r in stats.medians(df, ["g"], "v", "m").collect()} == {g: pytest.approx(float(np.median(v)), abs=1e-12) for g, v in groups.items()}


def test_raster_kernels():
    rng = np.random.default_rng(2)
    for _ in range(60):
        m = (rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.5).astype(np.uint8)
        n, labels = pixels.components(m)
        seen, count = np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if not seen[y, x]:
                count += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not seen[a, b]:
                        seen[a, b] = count
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert n == count and (labels == seen).all()
        best = max(((c - a) * (d - b) for b in range(m.shape[0]) for d in range(b + 1, m.shape[0] + 1) for a in range(m.shape[1]) for c in range(a + 1, m.shape[1] + 1) if m[b:d, a:c].all()), default=0)
        box = pixels.largest_rectangle(m)
        assert best == ((box[2] - box[0]) * (box[3] - box[1]) if box else 0)
        assert box is None or m[box[1] : box[3], box[0] : box[2]].all()
        back = np.zeros_like(m)
        for y, a, b in pixels.runs(m):
            back[y, a:b] = 1
        assert (back == m).all()
        wide = pixels.dilate(m, 1, 1)
        assert all(wide[y, x] == m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() for y in range(m.shape[0]) for x in range(m.shape[1]))
        assert (pixels.erode(m, 1, 1) <= m).all()
    y, x = np.mgrid[:12, :15]
    flat = np.repeat((3 * x + 2 * y + 20)[:, :, None], 3, axis=2).astype(np.uint8)
    hole = np.zeros((12, 15), np.uint8)
    hole[4:8, 5:9] = 1
    spoiled = flat.copy()
    spoiled[hole > 0] = 255
    assert (pixels.plane_fill(spoiled, hole, 1 - hole) == flat).all()


def test_raster_shapes(spark):
    rows = QUERIES["raster_shapes"](spark, SF).collect()
    assert rows and all(r.rectangle_area <= r.largest for r in rows)


def test_windowed_counts(spark):
    from pyspark.sql import functions as F

    from vellum.plans.source_plans import _stream, folder
    from vellum.streaming import cache

    at = folder(spark)
    counts = cache.counts_by_window(_stream(spark, SF), "ts")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    events = fx.table(spark, SF, "events")
    want = events.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()
    got = spark.table("counts").select(F.to_date("w.start").alias("d"), "event_type", "n").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def wrapped_lines(words, width):
    lines, now = [], ""
    for word in words:
        joined = f"{now} {word}" if now else word
        if len(joined) <= width:
            now = joined
            continue
        if now:
            lines.append(now)
        pieces = [word[i : i + width] for i in range(0, len(word), width)]
        lines, now = lines + pieces[:-1], pieces[-1]
    return len(lines) + (now != "" or not lines)


def test_fit_font_reads_whole_texts(spark):
    texts = documents(spark)
    boxes = {(r.page_id, r.region_id): (r.x2 - r.x1, r.y2 - r.y1) for r in fx.regions(spark, SF).collect() if r.page_id in texts}
    got = {(r.page_id, r.region_id): (r.font_size, r.n_lines) for r in QUERIES["fit_font"](spark, SF).collect()}
    assert got.keys() == boxes.keys()
    for (page, region), (w, h) in boxes.items():
        words, w, h = texts[page].split(), max(1, w - 16), max(1, h - 16)
        lines = lambda s: wrapped_lines(words, max(1, int(w / (s * 0.6))))  # noqa: B023, E731
        size = max(7, math.floor(min(h * 0.48, w * 0.42, 56)))
        while size > 7 and not (int(w / (size * 0.6)) >= 1 and lines(size) * math.ceil(size * 1.2) <= h):
            size -= 1
        assert got[page, region] == (size, lines(size)), (page, region)


def test_position_candidates_take_every_region(spark):
    half = lambda x: round(x)  # noqa: E731  half to even
    expected = set()
    for r in fx.regions(spark, SF).collect():
        bw, bh = 20 + r.page_id % 50, 10 + r.page_id % 40
        last_x, last_y = r.x2 - bw, r.y2 - bh
        if last_x < r.x1 or last_y < r.y1:
            continue
        step = max(2, min(bw, bh) // 10)
        centres = [((r.x1 + r.x2) / 2, r.y1 + 30.0), (r.x2 - 10.0, (r.y1 + r.y2) / 2), ((r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2)]
        for cx, cy in centres:
            for dx, dy in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)):
                x, y = half(cx + step * dx - bw / 2), half(cy + step * dy - bh / 2)
                expected.add((r.page_id, r.region_id, min(max(x, r.x1), last_x), min(max(y, r.y1), last_y)))
        axis = lambda lo, hi, size: [half(lo + i * ((hi - lo) / (n - 1))) for n in (min(5, max(2, (hi - lo) // max(1, size // 2) + 1)),) for i in range(n)]
        expected |= {(r.page_id, r.region_id, x, y) for x in axis(r.x1, last_x, bw) for y in axis(r.y1, last_y, bh)}
    got = [tuple(r) for r in QUERIES["position_candidates"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert max(region for _, region, _, _ in got) >= 2


def test_layout_variants_read_whole_texts(spark):
    squeezed = lambda t: " ".join(t.split())
    got = {r.doc_id: r.variants for r in QUERIES["layout_variants"](spark, SF).collect()}
    for doc, text in documents(spark).items():
        clean = squeezed(text)
        words, found = clean.split(" "), [clean]
        bare = re.sub("^[ ,.;:]+|[ ,.;:]+$", "", squeezed(re.sub(r"\([^)]{1,80}\)", "", clean)))
        found += [bare] if bare else []
        found += [p for p in (re.split(cut, clean, maxsplit=1)[0].strip() for cut in (r"(?<=[.!?])\s+", r"[,;:]\s+")) if 16 <= len(p) < len(clean)]
        found += [clean if len(words) <= n else re.sub("[.,;:]+$", "", " ".join(words[:n])) + "..." for n in (16, 12, 9)]
        assert got[doc] == ("" if not clean else clean if len(clean) < 55 else "|".join(dict.fromkeys(found))), doc


def test_cache_id_hashes_the_whole_source(spark, tmp_path):
    head = "x" * 300
    spark.createDataFrame([(1, "u", head + "a" * 99), (2, "u", head + "b" * 99), (3, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.cache_id for r in QUERIES["cache_id"](spark, str(tmp_path)).collect()}
    assert len(set(got.values())) == 3 and got[3].endswith(":")


def test_shorten_text_uses_whole_texts(spark, tmp_path):
    from vellum.operators import translate

    lead = "There are lots of (odd) things that really do not know. It is the end of "
    texts = [(i, "word " * (3 + 7 * i) + "tail" + str(i)) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    keep, translate.shortened = translate.shortened, lambda df, text, budget: seen.append(df.select("page_id", text)) or keep(df, text, budget)
    try:
        QUERIES["shorten_text"](spark, str(tmp_path)).collect()
    finally:
        translate.shortened = keep
    assert {r.page_id: r.said for r in seen[0].collect()} == {i: lead + re.sub("[^A-Za-z .,]", " ", t) for i, t in texts}


@pytest.mark.parametrize("name", ["run_report", "report_warnings"])
def test_reports_move_documents_once(spark, name):
    """Texts are in one exchange, the two places that read it share it; what else moves are numbers and flags."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any("text" in line or "en_text" in line for line in joins)
    moved = re.findall(r"RepartitionByExpression \[doc_id", plan)
    assert len(moved) == 2 and not re.search(r"(?m)^.*Project \[page_id.*\btext#.*\n.*Join", plan)


def test_items_meet_their_boxes_and_best_bubbles(spark):
    """Pages without bubbles or boxes, shares at the floor, equal shares, more items than boxes."""
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 20, 0, 30, 10), (2, 0, 0, 0, 10, 10), (3, 0, 0, 0, 100, 1)], "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int")
    held = spark.createDataFrame([(1, 2, 0, 0, 5, 10), (1, 1, 5, 0, 10, 10), (1, 0, 0, 0, 1, 10), (3, 4, 82, 0, 200, 9), (3, 5, 83, 0, 200, 9), (9, 0, 0, 0, 9, 9)], "page_id long, bubble_id int, x1 int, y1 int, x2 int, y2 int")
    best = routing.best_bubble(boxes, held)
    assert {(r.page_id, r.region_id): r.bubble_idx for r in best.collect()} == {(1, 0): 1, (1, 1): -1, (2, 0): -1, (3, 0): 4}
    items = spark.createDataFrame([(1, k, f"t{k}") for k in range(5)] + [(4, 0, "x")], "page_id long, region_id int, text string")
    assert sorted((r.region_id, r.text, r.x1, r.bubble_idx) for r in fx.placed(best, items).collect()) == [(k, f"t{k}", 20 * (k % 2), 1 - 2 * (k % 2)) for k in range(5)]

"""Run tables and what is made of them, against plain pixels."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import bubbles as B
from vellum.operators import pixels as P
from vellum.operators import runs

W, H = 40, 30


def pixels_of(spans):
    return {(s["y"], x) for s in spans for x in range(s["x_start"], s["x_end"])}


def random_mask(rng, n, longest=12):
    return [(rng.randrange(H), x, min(W, x + rng.randrange(1, longest))) for x in (rng.randrange(W - 1) for _ in range(n))]


@pytest.fixture(scope="module")
def pages(spark):
    """Pages with random masks; page 1 has most runs, page 4 none, page 3 no bubble; odd runs that count for nothing."""
    rng = random.Random(3)
    ink = [(p, *r) for p, n in ((0, 25), (1, 160), (2, 40), (3, 30)) for r in random_mask(rng, n)]
    bubbles = [(p, b, *r) for p, n in ((0, 3), (1, 5), (2, 4)) for b in range(n) for r in random_mask(rng, 30, 20)]
    odd = [(0, 5, 9, 9), (0, 5, 9, 3), (1, None, 1, 4)]
    boxes = [(p, k, x, y, min(W, x + 22), min(H, y + 12)) for p in range(5) for k, (x, y) in enumerate(((0, 0), (10, 5), (18, 18), (30, 2), (5, 5)))]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return {
        "ink": (ink, df(ink + odd + ink[:5], "page_id long, y int, x_start int, x_end int")),
        "bubbles": (bubbles, df(bubbles + bubbles[:9], "page_id long, bubble_id int, y int, x_start int, x_end int")),
        "boxes": (boxes, df(boxes, "page_id long, box_id int, x1 int, y1 int, x2 int, y2 int")),
        "sizes": df([(p, W, H) for p in range(5)], "page_id long, w int, h int"),
    }


def dots(rows, key=1):
    out = {}
    for r in rows:
        out.setdefault(r[:key] if key > 1 else r[0], set()).update((r[key], x) for x in range(r[key + 1], r[key + 2]))
    return out


def by_page(df):
    out = {}
    for r in df.collect():
        own = {(r.y, x) for x in range(r.x_start, r.x_end)}
        assert not own & out.setdefault(r.page_id, set()) and own
        out[r.page_id] |= own
    return {k: v for k, v in out.items() if v}


def test_set_operations_equal_sets_of_pixels(pages):
    (a_rows, a), (b_rows, b) = pages["ink"], pages["bubbles"]
    x, y = dots(a_rows), dots([(r[0], *r[2:]) for r in b_rows])
    full = {(i, j) for i in range(H) for j in range(W)}
    both = lambda rule: {p: s for p in range(5) if (s := rule(x.get(p, set()), y.get(p, set())))}
    assert by_page(runs.union(a, b)) == both(lambda s, t: s | t)
    assert by_page(runs.intersection(a, b)) == both(lambda s, t: s & t)
    assert by_page(runs.difference(a, b)) == both(lambda s, t: s - t)
    assert by_page(runs.complement(a, pages["sizes"])) == both(lambda s, t: full - s)
    assert runs.union(a.limit(0), b.limit(0)).count() == 0 and by_page(runs.difference(a, b.limit(0))) == x
    once = runs.union(a, b).collect()
    touching = {(r.page_id, r.y, r.x_end) for r in once} & {(r.page_id, r.y, r.x_start) for r in once}
    assert not touching  # one form only
    for r in runs.measures(runs.merged(b, ("page_id", "bubble_id")), ("page_id", "bubble_id")).collect():
        own = dots(b_rows, 2)[r.page_id, r.bubble_id]
        assert (r.n, r.x1, r.y1, r.x2, r.y2) == (len(own), min(c for _, c in own), min(c for c, _ in own), max(c for _, c in own) + 1, max(c for c, _ in own) + 1)


def plain_claims(pages, least=20, floating=30):
    ink, over = dots(pages["ink"][0]), dots(pages["bubbles"][0], 2)
    out = {}
    for p, k, x1, y1, x2, y2 in pages["boxes"][0]:
        left = {(y, x) for y, x in ink.get(p, set()) if x1 <= x < x2 and y1 <= y < y2}
        for b in sorted(b for q, b in over if q == p):
            if len(left & over[p, b]) > least:
                out[p, k, b] = left & over[p, b]
                left = left - over[p, b]
        if len(left) > floating:
            out[p, k, -1] = left
    return out


def test_bubbles_claim_ink_in_their_order(pages):
    cells = B.ink_cells(pages["ink"][1], pages["bubbles"][1])
    claimed = B.claims(cells, pages["boxes"][1])
    expected = plain_claims(pages)
    got = {(r.page_id, r.box_id, r.bubble_idx): (r.n, r.x1, r.y1, r.x2, r.y2) for r in B.routes(claimed).collect()}
    bounds = lambda s: (len(s), min(x for _, x in s), min(y for y, _ in s), max(x for _, x in s) + 1, max(y for y, _ in s) + 1)
    assert got == {k: bounds(s) for k, s in expected.items()} and any(b > 0 for _, _, b in got) and any(b < 0 for _, _, b in got)
    taken = {}
    for r in B.claimed_ink(cells, pages["boxes"][1], claimed).collect():
        taken.setdefault((r.page_id, r.box_id, r.bubble_idx), set()).update((r.y, x) for x in range(r.x_start, r.x_end))
    assert taken == expected
    assert B.claims(B.ink_cells(pages["ink"][1], pages["bubbles"][1].limit(0)), pages["boxes"][1]).where("bubble_idx >= 0").count() == 0


def flooded(cells, start, steps):
    seen, queue = {start}, deque([start])
    while queue:
        y, x = queue.popleft()
        for dy, dx in steps:
            if (n := (y + dy, x + dx)) in cells and n not in seen:
                seen.add(n)
                queue.append(n)
    return seen


FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))


def outer(mask):
    """Components that the background around the mask meets."""
    on = set(zip(*map(lambda a: a.tolist(), np.nonzero(mask)), strict=True))
    frame = {(y, x) for y in range(-1, mask.shape[0] + 1) for x in range(-1, mask.shape[1] + 1)} - on
    outside = flooded(frame, (-1, -1), FOUR)
    found, left = [], set(on)
    while left:
        own = flooded(left, min(left), EIGHT)
        left -= own
        if any((y + dy, x + dx) in outside for y, x in own for dy, dx in FOUR):
            found.append(own)
    return found


@pytest.mark.parametrize("seed", range(8))
def test_outer_components_holes_and_closing(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((18, 22)) < (0.25, 0.45, 0.6, 0.75)[seed % 4]
    if seed == 5:  # a ring with an island in it
        mask[:] = False
        mask[2:15, 3:19] = True
        mask[4:13, 5:17] = False
        mask[7:9, 9:12] = True
    n, labels = P.outer_components(mask)
    expected = outer(mask)
    assert sorted(sorted(zip(*map(lambda a: a.tolist(), np.nonzero(labels == j)), strict=True)) for j in range(1, n + 1)) == sorted(map(sorted, expected))
    for j, box in enumerate(P.label_bounds(labels), 1):
        assert box == P.bounds(labels == j)
    full = P.filled(labels)
    for j in range(1, n + 1):
        rest = {(y, x) for y in range(-1, 19) for x in range(-1, 23)} - set(zip(*map(lambda a: a.tolist(), np.nonzero(labels == j)), strict=True))
        inside = rest - flooded(rest, (-1, -1), FOUR)
        assert all(full[y, x] == j for y, x in inside if not labels[y, x])
    kw, kh = (2, 5) if seed % 2 else (12, 3)
    at = lambda m, y, x, out: m[y, x] if 0 <= y < 18 and 0 <= x < 22 else out
    box = [(dy, dx) for dy in range(-(kh // 2), kh - kh // 2) for dx in range(-(kw // 2), kw - kw // 2)]
    wide = np.array([[any(at(mask, y + dy, x + dx, False) for dy, dx in box) for x in range(22)] for y in range(18)])
    thin = np.array([[all(at(wide, y + dy, x + dx, True) for dy, dx in box) for x in range(22)] for y in range(18)])
    assert (P.spread(mask, kw, kh) == wide).all() and (P.closed(mask, kw, kh) == thin).all()


def plain_strict(ink, box, kernel):
    x1, y1, x2, y2 = box
    kw, kh = kernel
    mask = np.zeros((y2 - y1, x2 - x1), bool)
    for y, x in ink:
        for dy in range(-(kh - 1 - kh // 2), kh // 2 + 1):
            for dx in range(-(kw - 1 - kw // 2), kw // 2 + 1):
                if 0 <= y - y1 + dy < mask.shape[0] and 0 <= x - x1 + dx < mask.shape[1]:
                    mask[y - y1 + dy, x - x1 + dx] = True
    out = []
    for own in outer(mask):
        t, b, l, r = min(y for y, _ in own), max(y for y, _ in own) + 1, min(x for _, x in own), max(x for _, x in own) + 1
        inside = [(y, x) for y, x in ink if t <= y - y1 < b and l <= x - x1 < r]
        if (r - l) * (b - t) > 100 and inside:
            strict = (min(x for _, x in inside), min(y for y, _ in inside), max(x for _, x in inside) + 1, max(y for y, _ in inside) + 1)
            if (strict[2] - strict[0]) * (strict[3] - strict[1]) >= 120:
                out.append(strict)
    return out


def test_routed_boxes_are_strokes_then_semantic_regions(spark, pages):
    boxes = {(p, k): b for p, k, *b in pages["boxes"][0]}
    claimed, over = plain_claims(pages), dots(pages["bubbles"][0], 2)
    strict = sorted((p, "text", k, b, *box) for (p, k, b), ink in claimed.items() for box in plain_strict(ink, boxes[p, k], (2, 5) if b >= 0 else (4, 4)))
    regions = [(p, i, 0.25, x, y, min(W, x + 14), min(H, y + 9)) for p in range(5) for i, (x, y) in enumerate(((0, 18), (2, 20), (24, 0), (20, 12), (38, 28)))]
    extra = []
    for p, i, _, x1, y1, x2, y2 in regions:
        area = (x2 - x1) * (y2 - y1)
        shared = lambda b: max(0, min(x2, b[2]) - max(x1, b[0])) * max(0, min(y2, b[3]) - max(y1, b[1]))  # noqa: B023, E731
        if area < 100 or any(q == p and shared(b) / min(area, (b[2] - b[0]) * (b[3] - b[1])) > 0.3 for q, _, _, _, *b in strict):
            continue
        own = {(y, x) for y in range(y1, y2) for x in range(x1, x2)}
        extra.append((p, "semantic", i, next((b for b in sorted(b for q, b in over if q == p) if len(own & over[p, b]) / area > 0.4), -1), x1, y1, x2, y2))
    semantic = spark.createDataFrame(regions, "page_id long, region_id int, score double, x1 int, y1 int, x2 int, y2 int")
    make = lambda dropped=None: B.routing_state(pages["ink"][1], pages["bubbles"][1], pages["boxes"][1], semantic, pages["sizes"], dropped)
    got = make().collect()
    assert sorted((r.page_id, r.source, r.source_id, r.bubble_idx, r.x1, r.y1, r.x2, r.y2) for r in got) == sorted(strict + extra) and strict and extra
    for r in got:
        l, t, rr, b = (0, 0, W, H) if r.bubble_idx < 0 else (lambda s: (min(x for _, x in s), min(y for y, _ in s), max(x for _, x in s) + 1, max(y for y, _ in s) + 1))(over[r.page_id, r.bubble_idx])
        assert (r.ex1, r.ey1, r.ex2, r.ey2) == (max(l, r.x1 - 8), max(t, r.y1 - 8), min(rr, r.x2 + 8), min(b, r.y2 + 8))
        assert (r.route, r.action) == (("bubble_dialogue", "erase") if r.bubble_idx >= 0 else ("floating_dialogue", "careful_erase"))
    gone = [(r.page_id, r.x1, r.y1, r.x2, r.y2) for r in got if r.source == "text"][:2]
    left = make(spark.createDataFrame(gone, "page_id long, x1 int, y1 int, x2 int, y2 int")).where("source = 'text'").collect()
    assert not {(r.page_id, r.x1, r.y1, r.x2, r.y2) for r in left} & set(gone)


def test_clusters_of_bubbles_and_of_the_open_page(spark):
    block = lambda x1, y1, x2, y2: [(7, y, x1, x2) for y in range(y1, y2)]
    # a bubble with two words side by side (joined across 10 pixels) and one far below; a third word outside, a speck that counts for nothing
    ink = block(60, 40, 80, 50) + block(95, 42, 110, 50) + block(60, 150, 90, 160) + block(300, 300, 330, 320) + block(200, 10, 203, 13)
    bubble = [(7, 4, *r[1:]) for r in block(40, 20, 160, 220)]
    df = lambda rows, extra="": spark.createDataFrame(rows, f"page_id long{extra}, y int, x_start int, x_end int")
    routed = spark.createDataFrame([(7, "bubble_dialogue", 0.9, 61, 41, 70, 45), (7, "onomatopoeia", 0.4, 96, 43, 99, 45), (7, "onomatopoeia", 0.3, 100, 43, 105, 45), (7, "bubble_dialogue", 0.7, 305, 305, 310, 310)], "page_id long, route string, score double, x1 int, y1 int, x2 int, y2 int")
    sizes = spark.createDataFrame([(7, 400, 400), (8, 10, 10)], "page_id long, w int, h int")
    got = {(r.bubble_idx, r.cluster): r for r in B.consolidated(df(ink), df(bubble, ", bubble_id int"), routed, sizes).collect()}
    assert {k: (r.x1, r.y1, r.x2, r.y2) for k, r in got.items()} == {(4, 0): (61, 41, 110, 50), (4, 1): (61, 151, 90, 160), (-1, 0): (301, 301, 331, 321)}  # closing by an even kernel moves strokes by one
    assert [(got[k].route, got[k].action, got[k].mask_mode, got[k].confidence) for k in sorted(got)] == [("floating_dialogue", "careful_erase", "stroke", 0.7), ("onomatopoeia", "erase", "bubble_interior", 0.9), ("bubble_dialogue", "erase", "bubble_interior", 0.5)]
    a, b = got[4, 0], got[4, 1]
    # the bubble, 3 pixels less at its border, is dealt to the nearest box (with its right and lower edge), ties to the first
    far = lambda x, y, r: max(0, r.x1 - x, x - r.x2) ** 2 + max(0, r.y1 - y, y - r.y2) ** 2
    zone = {(x, y): far(x, y, b) < far(x, y, a) for x in range(43, 157) for y in range(23, 217)}
    for r, second in ((a, False), (b, True)):
        own = [p for p, of in zone.items() if of == second]
        xs, ys = [x for x, _ in own], [y for _, y in own]
        assert (r.gx1, r.gy1, r.gx2, r.gy2) == (max(46, min(xs)), max(30, min(ys)), min(154, max(xs)), min(210, max(ys)))
    assert min(a.gx1, b.gx1) >= 46 and max(a.gx2, b.gx2) <= 154 and a.gy1 >= 30 and b.gy2 <= 210  # 5 % inside the bubble
    assert (got[-1, 0].gx1, got[-1, 0].gy1, got[-1, 0].gx2, got[-1, 0].gy2) == (299, 299, 332, 332 - 10)
    assert B.consolidated(df(ink).limit(0), df(bubble, ", bubble_id int"), routed, sizes).count() == 0


def test_rescue_boxes_are_the_largest_rectangle_at_the_centroid(spark):
    rows = [(1, 0, y, 5, 35) for y in range(4, 24)] + [(1, 1, y, 0, 3) for y in range(3)]
    ring = [(2, 0, y, 0, 40) for y in (0, 1, 2, 3, 27, 28, 29)] + [(2, 0, y, a, b) for y in range(4, 27) for a, b in ((0, 4), (36, 40))]
    df = spark.createDataFrame(rows + ring, "page_id long, bubble_id int, y int, x_start int, x_end int")
    routed = spark.createDataFrame([(9, 0)], "page_id long, bubble_idx int")
    got = {(r.page_id, r.bubble_idx): (r.x1, r.y1, r.x2, r.y2) for r in B.rescues(df, routed).collect()}
    assert got == {(1, 0): (5, 4, 35, 24), (2, 0): (0, 0, 40, 4)}
    assert B.rescues(df, spark.createDataFrame([(1, 0), (2, 0)], "page_id long, bubble_idx int")).count() == 0

"""Masks of whole pages give the rows of the operators over run tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import areas as A
from vellum.operators import bubbles as B
from vellum.operators import page_masks as M
from vellum.operators import pixels as P
from vellum.plans.registry import QUERIES
from vellum.sources import fixtures as fx


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Pages without markup, of one character, one row, tags only, long words, characters of two code units, and random ones."""
    rng, d = random.Random(4), str(tmp_path_factory.mktemp("pages"))
    word = lambda: "".join(rng.choices("abcXYZ019é漢😀-", k=rng.randrange(1, 14)))
    part = lambda: rng.choice(["<p>", "</p>", "<b", ">", "<", "<div class=x>", " ".join(word() for _ in range(rng.randrange(1, 60))), " " * rng.randrange(200)])
    markup = [None, "", "a", "x" * 96, "y" * 97, "<p><p><p>", "z" * 3000, "<" * 500, "abc " * 400, " " * 900, *["".join(part() for _ in range(n)) for n in (3, 10, 40, 40, 200)]]
    rows = [(7 * i + 1, x) for i, x in enumerate(markup)] + [(None, "no page " * 40)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    return d


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def claimed(spark, d):
    return B.routes(B.claims(B.ink_cells(fx.ink(spark, d), fx.contents(spark, d)), fx.windows(spark, d)))


def items(spark, d):
    item = (F.col("box_id") * 1000 + F.col("bubble_idx") + 1).cast("int").alias("item_id")
    pad = [(F.col(c) + by).alias(c) for c, by in (("x1", -2), ("y1", -2), ("x2", 2), ("y2", 2))]
    return QUERIES["bubble_claims"](spark, d).select("page_id", item, "bubble_idx", *pad).join(fx.sizes(spark, d), "page_id")


def test_claims(spark, odd):
    want, got = claimed(spark, odd).withColumn("earlier", F.array_join("earlier", ",")), QUERIES["bubble_claims"](spark, odd)
    assert want.dtypes == got.dtypes and rows(got, *want.columns) == rows(want, *want.columns) and want.count() > 50


def test_allowed_masks(spark, odd):
    own = items(spark, odd)
    erased = own.where("bubble_idx < 0 AND item_id % 2000 = 0").select("page_id", "item_id", "x1", "y1", (F.col("x1") + 12).alias("x2"), "y2")
    want, got = A.allowed_masks(own, fx.contents(spark, odd), fx.ink(spark, odd), erased), QUERIES["allowed_masks"](spark, odd)
    assert want.dtypes == got.dtypes and rows(got, *want.columns) == rows(want, *want.columns) and erased.count() > 5


def test_shrunk_boxes(spark, odd):
    for d in (odd, "/root/testdata/sf0.001"):
        want, got = A.shrunk_boxes(items(spark, d), QUERIES["allowed_masks"](spark, d), safety=1), QUERIES["shrunk_boxes"](spark, d)
        assert want.dtypes == got.dtypes and rows(got, *want.columns) == rows(want, *want.columns) and want.count() > 50


def test_routed_boxes(spark, odd):
    w = fx.windows(spark, odd).where("box_id % 2 = 1")
    regions = w.select("page_id", F.col("box_id").alias("region_id"), (0.5 + (F.col("box_id") % 5) / 10).alias("score"), (F.col("x1") + 3).alias("x1"), "y1", F.least(F.lit(fx.ROW), F.col("x2") + 3).alias("x2"), "y2")
    want, got = B.routing_state(fx.ink(spark, odd), fx.contents(spark, odd), fx.windows(spark, odd), regions, fx.sizes(spark, odd)), QUERIES["routed_boxes"](spark, odd)
    assert want.dtypes == got.dtypes and rows(got, *want.columns) == rows(want, *want.columns)
    assert {(r.source, r.bubble_idx < 0) for r in got.collect()} == {(s, b) for s in ("text", "semantic") for b in (True, False)}


@pytest.mark.parametrize("seed", range(6))
def test_strokes_of_random_ink(seed):
    """Rings, parts in holes, parts that touch at corners and at the border of their box."""
    rng = np.random.default_rng(seed)
    h, w = int(rng.integers(30, 60)), 70
    mask = rng.random((h, w)) < (0.03, 0.08, 0.15, 0.3, 0.02, 0.5)[seed]
    for y in range(0, h - 12, 14):
        mask[y : y + 12, 5:40] = True
        mask[y + 2 : y + 10, 8:37] = False
        mask[y + 5 : y + 7, 20:26] = True
    ink = np.array([(0, y, a, b) for y, a, b in P.runs(mask)])
    at = [(int(x), int(y), int(min(w, x + 45)), int(min(h, y + 16))) for x, y in zip(rng.integers(0, 50, 20), rng.integers(0, h - 5, 20), strict=True)]
    bubble = np.array([(0, y, 0, 35) for y in range(h)])
    p = M.Pages(np.array([w]), np.array([h]), ink, bubble, np.array([0]), np.array([0]), np.zeros(20, np.int64), np.arange(20), np.array(at))
    c = M.claims(p)
    claim, part, found = M.stroke_boxes(p, c)
    got = {i: [tuple(map(int, b)) for j, b in zip(claim, found, strict=True) if j == i] for i in range(len(c.box))}
    for i, (box, held) in enumerate(zip(c.box.tolist(), c.bubble.tolist(), strict=True)):
        own = [{"y": y, "x_start": max(a, x1), "x_end": min(b, x2)} for x1, y1, x2, y2 in [at[box]] for _, y, a0, b0 in ink.tolist() if y1 <= y < y2 for a, b in [(a0, min(b0, 35)) if held >= 0 else (max(a0, 35), b0)] if max(a, x1) < min(b, x2)]
        own = own if -1 in c.bubble[c.box == box] and 0 in c.bubble[c.box == box] or held >= 0 else None
        if own is not None:
            assert got[i] == B.stroke_boxes(own, at[box], B.INSIDE if held >= 0 else B.OUTSIDE)
    assert sum(map(len, got.values())) >= 10


def test_clusters_and_rescues(spark, odd):
    claims, (ink, held) = claimed(spark, odd), (fx.ink(spark, odd), fx.contents(spark, odd))
    routed = claims.select("page_id", "route", F.lit(1.0).alias("score"), "x1", "y1", "x2", "y2")
    want, got = B.consolidated(ink, held, routed, fx.sizes(spark, odd)), QUERIES["bubble_clusters"](spark, odd)
    assert want.dtypes == got.dtypes and rows(got, *want.columns) == rows(want, *want.columns) and {r.bubble_idx < 0 for r in got.collect()} == {True, False}
    want, got = B.rescues(held, claims), QUERIES["rescue_boxes"](spark, odd)
    assert want.dtypes == got.dtypes and rows(got, *want.columns) == rows(want, *want.columns) and got.count() > 0


@pytest.mark.parametrize("name", ["bubble_claims", "bubble_clusters", "rescue_boxes", "routed_boxes", "allowed_masks", "clipped_blocks", "shrunk_boxes"])
def test_only_markup_is_shuffled(spark, odd, name):
    plan = QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

"""Rules at their boundary values, on hand-written rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import report, translate, typeset
from vellum.sources import io


def each(spark, make, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} {t}" for k, t in enumerate(_kinds(rows))))
    return [r.out for r in df.select("i", make(*[F.col(f"c{k}") for k in range(len(rows[0]))]).alias("out")).orderBy("i").collect()]


def _kinds(rows):
    first = [next((r[k] for r in rows if r[k] is not None), "") for k in range(len(rows[0]))]
    return ["string" if isinstance(x, str) else "double" if isinstance(x, float) else "int" for x in first]


def test_classify(spark):
    cases = {None: "noise", "  ": "noise", "hello": "english", "あいうえおa": "dialogue", "あいうえab": "english", "12": "noise", "…!": "noise", "가나다": "dialogue", "가나": "sfx", "가나1": "dialogue", "漢字": "dialogue", "漢": "sfx", "ドドドドドド": "sfx", "ドドドドドドドドドドド": "noise", "あいう": "sfx", "あいうえお": "sfx", "あいうえおか": "dialogue", "漢あいうえ": "dialogue", "ああアアアアああア": "dialogue"}
    assert each(spark, T.classify, *[(k,) for k in cases]) == list(cases.values())


def test_usable_and_strong(spark):
    cases = {None: False, "": False, "…": True, "…………………": False, "～～": False, "漢字": True, "ok": True, "x" * 24: True, "x" * 25: False}
    assert each(spark, T.usable, *[(k,) for k in cases]) == list(cases.values())
    cases = {"あいう": False, "あいうえ": True, "漢漢あ": False, "漢漢ああ": False, "漢漢ああ漢": True, "가나다라": True}
    assert each(spark, T.strong_dialogue, *[(k,) for k in cases]) == list(cases.values())


def test_answers(spark):
    said = {None: "", '```json\n"Hi   there"```': "Hi there", "Translation: you &amp; me": "you & me", "x" * 400: "x" * 360}
    assert each(spark, T.clean_answer, *[(k,) for k in said]) == list(said.values())
    pairs = [("漢字だ", "Kanji"), ("漢字だ", ""), ("漢字だ", "[TL: x]"), ("漢字だ", "漢字"), ("漢字だ", "…"), ("漢", "…"), ("漢", "…" * 9), ("hello", "hello")]
    assert each(spark, T.valid_answer, *pairs) == [True, False, False, False, False, True, False, True]
    pairs = [("歯みがきしてこい", "I should go brush my teeth. I will go home."), ("歯", "I should go home."), ("してきて", "Wait.")]
    assert each(spark, translate.perspective, *pairs) == ["Go brush your teeth. I will go home.", "I should go home.", "Wait."]


def test_budget_and_hash(spark):
    assert each(spark, T.budget, (0, 10), (10, 10), (100, 50), (400, 400), (30, 60)) == [110, 16, 95, 120, 57]
    assert each(spark, T.fnv_hash, ("",), ("a",)) == ["", _fnv("a")]


def test_hash_of_many_texts(spark):
    """Long texts in time; null, empty, supplementary and strided ones side by side."""
    texts = [None, "", "😀é", "x" * 1999, "ab" * 2000, "ab漢" * 2001, *["y" * 3999 + chr(97 + i % 26) * (i % 7) for i in range(3000)]]

    def strided(t):
        h = 2166136261
        for c in [*map(ord, t[:: max(1, len(t) // 2000)]), len(t)]:
            h = (h ^ c) * 16777619 % 2**32
        return ("-" if h >= 2**31 else "") + np.base_repr(min(h, 2**32 - h), 36).lower()

    began = time.perf_counter()
    got = each(spark, T.fnv_hash, *[(t,) for t in texts])
    assert time.perf_counter() - began < 20
    assert got == [None if t is None else strided(t) if t else "" for t in texts]


def _fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 % 2**32
    h = (h ^ len(s)) * 16777619 % 2**32
    h, sign = (2**32 - h, "-") if h >= 2**31 else (h, "")
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return sign + out


def test_boxes(spark):
    def over(*c):
        return F.round(G.overlap(G.box(*c[:4]), G.box(*c[4:])), 4)

    assert each(spark, over, (0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 10, 10, 5, 0, 15, 10), (0, 0, 10, 10, 2, 2, 4, 4)) == [0.0, 0.5, 1.0]

    def near(*c):
        return G.line_link(G.box(*c[:4]), G.box(*c[4:]))

    assert each(spark, near, (0, 0, 100, 20, 0, 52, 100, 72), (0, 0, 100, 20, 0, 53, 100, 73), (0, 0, 100, 20, 300, 25, 400, 45)) == [True, False, False]
    assert each(spark, lambda w: G.render_scale(w), (900,), (899,), (400,), (100,)) == [1, 2, 3, 3]


def test_wrap_and_fit(spark):
    wrap = each(spark, lambda t, w: F.array_join(typeset.wrapped(t, w), "|"), ("a bb ccc", 4), ("abcdefghij", 4), ("", 5), ("x abcdefgh y", 3))
    assert wrap == ["a bb|ccc", "abcd|efgh|ij", "", "x|abc|def|gh|y"]
    df = spark.createDataFrame([("hello world", 200, 100), ("hello", 1, 1)], "t string, w int, h int")
    rows = typeset.fitted(df, "t", "w", "h").orderBy(F.desc("w")).collect()
    assert rows[0].font_size > 7 and rows[1].font_size == 7
    best = each(spark, lambda s, w: F.round(typeset.score(s, w, w, F.lit(100), F.lit(100), F.lit(10.0), F.lit(7), F.lit(1), F.lit(True)), 3), (10, 50))
    assert best == [380 + 65 - 8 - 14 - 12]


def test_data_urls(spark):
    df = spark.createDataFrame([(b"\x00\xffabc" * 40,)], "b binary")
    url = df.select(io.data_url(F.col("b")).alias("u"), "b")
    row = url.select("u", (io.decode_data_url(F.col("u")) == F.col("b")).alias("same")).first()
    assert row.same and row.u.startswith("data:image/png;base64,") and "\n" not in row.u


@pytest.mark.parametrize("there", [True, False])
def test_stage_files(spark, tmp_path, there):
    at = f"file://{tmp_path}/stage"
    if there:
        io.write_stage(spark.createDataFrame([("p", 1), ("q", 2)], "page_id string, id int"), at, "json")
    got = io.read_stage(spark, at, spark.createDataFrame([], "page_id string, id int").schema)
    assert got.count() == (2 if there else 0)


def test_stage_pages_are_replaced_alone(spark, tmp_path):
    at, kind = f"file://{tmp_path}/stage", "page_id string, id int"
    io.write_stage(spark.createDataFrame([(f"p{i}", i) for i in range(60)] + [("p0", 100)], kind), at, buckets=4)
    io.write_stage(spark.createDataFrame([("p0", 7), ("p3", 8), ("new", 9)], kind), at, buckets=4)
    got = sorted((r.page_id, r.id) for r in spark.read.parquet(at).collect())
    assert got == sorted([(f"p{i}", i) for i in range(60) if i not in (0, 3)] + [("p0", 7), ("p3", 8), ("new", 9)])
    assert len(list((tmp_path / "stage").glob("bucket=*"))) <= 4


def test_images(spark, tmp_path):
    for name, data in (("a.png", b"one"), ("b.jpg", b"one"), ("c.png", b"two"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    pages = io.read_images(spark, f"file://{tmp_path}")
    assert pages.count() == 3 and io.ingested(pages).count() == 2


def test_cache_misses(spark):
    req = spark.createDataFrame([(1, "ja"), (2, "ja"), (3, "ko")], "key int, language string")
    res = spark.createDataFrame([(1, "ja", "pass", 5, "v"), (2, "ja", "pass", 4, "v"), (3, "ja", "pass", 5, "v")], "key int, language string, status string, n_artifacts int, cache_version string")
    assert sorted(r.key for r in report.cache_misses(req, res, "v").collect()) == [2, 3]

"""Operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from vellum.llm import bpe, chat_format, common, docstats, graph, mixing, near_texts, quality_classifier, quality_rules, sharding, simhash, substring_dedup, topk_search, warc
from vellum.llm import textkernel as K

from vellum.llm.common import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_documents(seed=5, n=120):
    """Rows (doc_id, text, score, ids): every kind of odd text, repeated rows, null ids, columns named like results."""
    rng = random.Random(seed)
    vocab = ["a", "The", "é", "no!", "x" * 40, "猫です", "don't", "12", "re", "***"] + ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choices(vocab, k=70))
    texts = [None, "", "  \n\t ", "one", "one two", "\n\nx\nx\nx", "word " * 30_000]
    for i in range(n):
        t = "\n".join(" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 4)))
        texts.append(t + "  " + passage + "\n" + t[:40] if i % 5 == 0 else t)
    rows = [(i, t, 1.5, "x") for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, texts[11], None, None), (None, None, 0.0, "y"), (900, texts[12], 0.0, None), (901, (texts[12] or "") + " more", 0.0, None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_documents()
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score double, ids string").repartition(3)


def words(t):
    return WORD.findall(t or "")


def same(rows, expected):
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_substring_dedup(spark, odd):
    rows, df = odd
    size = 20
    count = Counter(tuple(w[i : i + size]) for r in rows for w in [words(r[1])] for i in range(len(w) - size + 1))
    expected = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        expected.append((r[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    got = substring_dedup.remove_repeated(df, window=size, joined=True, block_bytes=5000, bucket_windows=500)
    assert set(got.columns) == {"doc_id", "text", "score", "ids", "n_words", "n_removed", "removed", "kept_text"}
    same([(r.doc_id, r.n_words, r.n_removed, sha(r.kept_text)) for r in got.collect()], expected)
    for r in substring_dedup.remove_repeated(df, window=size).collect():
        w = words(r.text)
        stay = [x for i, x in enumerate(w) if not any(s["begin"] <= i < s["end"] for s in r.removed)]
        assert words(r.kept_text) == stay
        assert r.n_removed or r.kept_text == (r.text or "")


def brute_components(fps, ids, distance=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        k = find(i)
        least[k] = min((v for v in (least.get(k), x) if v is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def fingerprint(t, size=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd):
    rows, df = odd
    fps = [fingerprint(r[1]) for r in rows]
    expected = [(r[0], f, c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows]), strict=True)]
    got = simhash.near_duplicates(df).collect()
    same([(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got], expected)


def test_pipeline_near_duplicates_by_five_words(spark):
    import random

    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for _ in range(25):
        w = [word() for _ in range(rng.randint(40, 160))]
        texts.append(w)
        for _ in range(rng.randint(0, 4)):  # copies of copies, so components are chains
            w = list(w)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, " ".join(w)) for i, w in zip(ids, texts, strict=True)] + [(2000, "one two"), (2001, "One  two"), (2002, ""), (2003, None), (None, "alone here"), (3000, "left apart a b c"), (3000, "right apart d e f")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_texts.keep_one(none).count() == 0


def test_gray_tree_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    group, guests = fp[:300], fp[300:]
    a, b = simhash._local_links(group, guests, 2)
    links = {(int(x), int(y)) for x in group for y in fp if x != y and int(x ^ y).bit_count() <= 2}
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    assert all(find(x) == find(y) for x, y in links)
    parts = {int(x): int(x) for x in fp}

    def top(x):
        while parts[x] != x:
            x = parts[x]
        return x

    for x, y in links:
        parts[top(x)] = top(y)
    assert len({find(int(x)) for x in fp}) == len({top(int(x)) for x in fp})


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_round_trip(spark, odd):
    rows, df = odd
    path = bpe.tokenizer_path()
    enc = tiktoken.Encoding("t", pat_str=bpe.RUNS, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.encode(df, path, block_bytes=3000, bucket_words=50)
    assert coded.columns == ["doc_id", "score", "n_tokens", "ids"]
    same([(r.doc_id, r.n_tokens, bytes(r.ids)) for r in coded.collect()], [(r[0], len(x), np.array(x, "<u4").tobytes()) for r in rows for x in [enc.encode_ordinary(r[1] or "")]])
    same([(r.doc_id, bytes(r.decoded)) for r in bpe.decode(coded, path).collect()], [(r[0], (r[1] or "").encode()) for r in rows])


def test_pretokens_match_the_pattern():
    rng = random.Random(2)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "é", "9", "!", "　", "猫", "A", "́", "\x1c"]
    docs = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(4000)]
    buf, offs = K.raw(K.column(pa.array(docs)))
    start, end, first = bpe.pretokens(buf, offs)
    enc = regex.compile(bpe.RUNS.replace(r"\s", r"\p{White_Space}").replace("[^\\p{White_Space}", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    for d, text in enumerate(docs):
        assert [bytes(buf[start[i] : end[i]]).decode() for i in range(first[d], first[d + 1])] == enc.findall(text)
    slow = bpe._pattern_starts(buf, offs, enc.pattern)
    assert all((a == b).all() for a, b in zip((start, end, first), slow, strict=True))


def test_document_statistics(odd):
    rows, _ = odd
    got = docstats.counts(K.column(pa.array([r[1] for r in rows])))
    for i, r in enumerate(rows):
        w, t = words(r[1]), r[1] or ""
        triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = [False] * len(w)
        for k in range(len(w) - 2):
            if triples[tuple(w[k : k + 3])] > 1:
                covered[k : k + 3] = [True] * 3
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        assert tuple(int(got[c][i]) for c in docstats.COUNTS) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(covered))


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        w = ["".join(rng.choices("aeilnorst", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 150))]
        text = ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) if good else " ".join(x.upper() + "!!" if i % 8 else x + rng.choice(["***", "###", "$$$"]) for x in w)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels}


def test_quality_rules(spark, odd):
    docs, labels, truth = labelled(spark)
    forest = quality_rules.train(docs, labels)
    got = quality_rules.judge(docs, forest).collect()
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in got]) > 0.98
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 3, (400, len(quality_rules.FEATURES)))
    for f, sign in enumerate(quality_rules.FEATURES.values()):
        if sign:
            more = x.copy()
            more[:, f] += rng.uniform(0, 2, 400)
            assert (sign * (forest.score(more) - forest.score(x)) >= -1e-12).all()
    rows, df = odd
    judged = quality_rules.judge(df, forest)
    assert judged.count() == len(rows) and judged.where("base_failed and kept").count() == 0
    none = quality_rules.train(docs, labels.where("quality is null"))
    assert quality_rules.judge(docs, none).where("kept = base_failed").count() == 0
    assert quality_rules.judge(docs.limit(0), forest).count() == 0


def test_quality_classifier(spark, odd):
    docs, labels, truth = labelled(spark)
    voters = quality_classifier.train(docs, labels)
    got = quality_classifier.classify(docs, voters).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    rows, df = odd
    scored = quality_classifier.classify(df, voters)
    assert scored.columns == ["doc_id", "ids", "score", "predicted"] and scored.count() == len(rows)
    assert scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {1.0}


def test_classifier_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    c = rng.poisson(0.3, (60, quality_classifier.DIM)).astype(np.float32)
    y = (np.arange(60) % 3 > 0).astype(int)
    v = quality_classifier.fit(c, y, 0.8, rank=10, neighbours=5)
    q = rng.poisson(0.3, (7, quality_classifier.DIM)).astype(np.float32)
    z = quality_classifier._damped(q) @ v.projection
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for i, s in enumerate(v.score(q)):
        cosine = v.vectors @ z[i]
        near = np.argsort(-cosine)[:5]
        w = np.maximum(cosine[near], 1e-6).astype(float) ** v.sharpness * v.weight[near]
        assert abs(s - (w * y[near]).sum() / w.sum()) < 1e-5


def test_sharding(spark, odd):
    rows, df = odd
    got = sharding.shuffle_into_shards(df, shards=7, cell_rows=5).collect()
    same([tuple(r)[:4] for r in got], rows)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for k in count:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(count[k]))
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0
    few = sharding.shuffle_into_shards(df.limit(3), shards=7).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_sharding_draws_are_uniform():
    counts, sizes = [30, 0, 10, 60], [34, 33, 33]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
        total += m
    assert np.abs(total / 400 - np.outer(counts, sizes) / 100).max() < 0.5
    for size in (1, 2, 7, 100, 4097):
        assert sorted(sharding.scattered(np.arange(size), size, 9).tolist()) == list(range(size))
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 4 * 10**9, 6 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 400) < 4 and 12 < np.std(big) < 19
    huge = np.array([sharding.hypergeometric(rng, 4 * 10**12, 6 * 10**12, 10**9) for _ in range(300)])
    assert abs(huge.mean() - 4e8) < 4 * 15492 / 300**0.5 and 0.85 < huge.std() / 15492 < 1.15


def test_hypergeometric_law():
    """All probabilities of small draws, against counting."""
    rng = np.random.default_rng(1)
    for good, bad, sample in ((3, 4, 2), (5, 2, 5), (1, 1, 1), (6, 6, 6), (0, 4, 2), (4, 0, 2), (7, 3, 0)):
        all_ = math.comb(good + bad, sample)
        got = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(4000))
        for k in range(sample + 1):
            p = math.comb(good, k) * math.comb(bad, sample - k) / all_ if sample - k <= bad else 0
            assert abs(got[k] / 4000 - p) <= 4.5 * (p * (1 - p) / 4000) ** 0.5


def test_sharding_units(spark):
    """Many units in two levels: exact sums, and the driver sees groups only; nested columns and equal rows keep their values."""
    units = spark.range(100_000).select(F.col("id").alias(sharding.UNIT), (F.col("id") % 5).alias("n"))
    sizes = [200_000 // 7 + (k < 200_000 % 7) for k in range(7)]
    got = sharding.plan_units(units, 7, sizes, 3, most_groups=50).toPandas()
    counts, start = np.array(got["counts"].tolist()), np.array(got["start"].tolist())
    assert len(got) == 100_000 and (counts.sum(axis=1) == got[sharding.UNIT] % 5).all() and counts.sum(axis=0).tolist() == sizes
    for k in range(7):
        order = np.lexsort((counts[:, k], start[:, k]))
        assert (np.cumsum(counts[order, k])[:-1] == start[order, k][1:]).all()
    df = spark.range(500).select(F.lit(1).alias("a"), F.array(F.col("id") % 3).alias("list"), F.lit("x").alias("shard"), F.struct("id").alias("slot"))
    out = sharding.shuffle_into_shards(df.repartition(3), shards=4, cell_rows=20, unit_rows=16).collect()
    assert Counter(tuple(r["list"]) for r in out) == {(0,): 167, (1,): 167, (2,): 166}
    assert sorted((r.shard, r.slot) for r in out) == [(k, i) for k in range(4) for i in range(125)]


def test_top_products(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.standard_normal(12) * rng.uniform(0.1, 2)).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 340)] + [(340, None), (341, [0.0] * 12), (342, [1.0, None] + [0.0] * 10), (343, [float("nan")] * 12), (344, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (360, [1.0, 2.0]), (361, [2.0, 3.0]), (380, []), (400, [1e6] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in (i for i in good if i % 20 == 0):
        scores = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])]
    for how in ({}, {"block_rows": 16, "query_rows": 4, "seeds": 30, "group_blocks": 2, "coordinate_from": 0.1}, {"block_rows": 50, "seeds": 1, "coordinate_from": 2.0}):
        same([tuple(r) for r in topk_search.top_products(df, F.col("id") % 20 == 0, **how).collect()], expected)
    assert topk_search.top_products(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_products_beyond_53_bits(spark):
    """Exact whole-number products where floats round, where longs wrap and where 64 * x overflows; a query row that occurs twice."""
    rng = random.Random(5)
    size = lambda: rng.choice([1.0, 1e7, 3e7, 1e10, 1e17])
    vectors = [(i, [rng.uniform(-1, 1) * size() for _ in range(2)]) for i in range(60)]
    vectors += [(100, [1e7 + 0.5, 3.0]), (101, [1e7 + 1.3, 9.0]), (102, [1e308, -1e308]), (103, [-1e308, 1.0]), (104, [0.0, 0.0]), (100, [1e7 + 0.5, 3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = lambda v: [max(-(10**300), min(10**300, math.floor(Fraction(x) * 64))) for x in v]
    expected = []
    for q, v in (x for x in vectors if x[0] % 20 == 0):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(v), whole(w), strict=True)))), i) for i, w in vectors if i != q)
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])]
    assert (100, -409600073600113248) in {(q, s) for q, _, i, s in expected if i == 101} or (101, 409600073600113248) in {(i, s) for q, _, i, s in expected if q == 100}
    for how in ({}, {"block_rows": 8, "query_rows": 2, "seeds": 5, "group_blocks": 1, "coordinate_from": 0.2}):
        same([tuple(r) for r in topk_search.top_products(df, F.col("id") % 20 == 0, **how).collect()], expected)


def pages(rng):
    urls = ["http://a.b/x", "https://www.q.com:80/?b=1&a=2#z", "x\ny", "", None, "http://[bad"]
    htmls = [None, "", "é" * 60, "a" * 99, "a" * 100, "b\r\n\r\nWARC/1.0\r\n\r\n" * 20, "z" * 200_000]
    rows = [(i, rng.choice(urls), rng.choice(htmls), "x") for i in range(150)]
    return rows + [rows[3], (None, "http://a.b/n", "é" * 60, "x"), (None, None, None, None)]


def test_warc(spark):
    rows = pages(random.Random(6))
    at = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), at, records_per_file=7)
    got = warc.merge_index(warc.read_archives(spark, at), range_rows=20).collect()
    first = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    expected = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        expected.append((i, len(b), sha(b), "revisit" if revisit else "response", f if revisit else None))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], expected)
    got.sort(key=lambda r: r.index_pos)
    assert [r.index_pos for r in got] == list(range(len(rows)))
    assert [(r.urlkey, r.ts) for r in got] == sorted((r.urlkey, r.ts) for r in got)
    empty = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.merge_index(warc.read_archives(spark, empty)).count() == 0


def test_archives_are_inflated_piece_by_piece():
    blocks = [b"", b"x" * 300_000, "é\r\n\r\nWARC/1.1\r\n".encode() * 40, bytes(range(256)) * 900]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks]
    starts = [sum(map(len, records[:i])) for i in range(len(records))]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [(at, block) for at, _, block in warc.parse(memoryview(data))] == list(zip(starts, blocks, strict=True))
    for data in (gzip.compress(records[1][:-2]), gzip.compress(records[0] + b"WARC/1.1"), gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.parse(memoryview(data)))
    assert list(warc.parse(memoryview(gzip.compress(b"")))) == []


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.choices(range(9), k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_chat_turns(spark):
    rng = random.Random(9)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "<", "[", "é", "ok ", "\\<s>", "猫", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>[INST]"]), rng.choice([None, "", "x" * 3000, "".join(rng.choices(parts, k=9))]), 1) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "a", 1), (3, 0, "user", "again", 1), (3, 0, "user", "again", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_log(chat_format.turns_to_log(df, piece=7))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] is not None, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [tuple(t) for t in back[c].turns] == [(role, text) for _, _, role, text in own]
        assert list(back[c].loss_texts) == [text for _, _, role, text in own if role == "assistant"]
    assert chat_format.format_log(chat_format.turns_to_log(df.limit(0))).count() == 0


def test_chat_events(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "He"), (1, 2, 4, "delta", None, "llo"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "Good "), (1, 2, 8, "delta", None, "day"),
        (1, 1, 9, "edit", None, "hello"), (1, 3, 10, "delta", None, "orphan"), (2, 1, 1, "message", None, None),
    ]
    got = chat_format.final_messages(spark.createDataFrame(log, "conv_id long, msg_id long, seq long, kind string, role string, text string")).collect()
    same([(r.conv_id, r.at, r.role, r.text) for r in got], [(1, 1, "user", "hello"), (1, 2, "assistant", "Good day"), (1, 10, "", "orphan"), (2, 1, "", "")])


def test_mixing(spark, odd):
    rng = random.Random(3)
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}
    rows = [(i, " ".join("".join(rng.choices(letters[d], k=4)) for _ in range(rng.randint(5, 40))), d) for i in range(300) for d in [rng.choice(["aa", "aa", "aa", "bb", "bb", "cc"])]]
    docs = spark.createDataFrame(rows + [(None, None, None), (999, "", "aa")], "doc_id long, text string, lang string")
    labels = docs.select("doc_id")
    mixer, table, aim, reached = mixing.fit(docs, labels)
    assert mixer.domains == ("aa", "bb", "cc") and np.abs(aim - reached).max() < 2e-4 * aim.sum()
    got = mixing.rated(table, mixer).collect()
    assert len(got) == 302 and min(r.rate for r in got) >= 0
    p, n, r = np.array([x.posterior for x in got]), np.array([x.n_words for x in got]), np.array([x.rate for x in got])
    assert np.allclose((n * r) @ p, reached)
    # plain projected gradient descent on all rates, to the same objective
    rate, a = np.ones(len(got)), n[:, None] * p
    for _ in range(3000):
        rate = np.maximum(0, rate - (p @ (rate @ a - aim)) / aim.sum())
    assert np.abs(rate - r).max() < 2e-3
    up, _, _, _ = mixing.fit(docs, labels, temper=0.5, grow=True, least_rate=1.0)
    copies = Counter(x.doc_id for x in mixing.realised(docs, up).collect())
    assert len(copies) == 302 and sum(copies.values()) > 330
    alone, t, _, _ = mixing.fit(docs, labels.limit(0))
    assert alone.domains == ("all",) and {round(x.rate, 6) for x in mixing.rated(t, alone).collect()} == {1.0}
    _, empty, _, _ = mixing.fit(docs.limit(0), labels)
    assert empty.count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert substring_dedup.remove_repeated(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and near_texts.keep_one(none).count() == 0
    assert bpe.decode(bpe.encode(none, bpe.tokenizer_path()), bpe.tokenizer_path()).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        seen.append({r.doc_id for r in docs.collect()})
        assert name == "tokens" or docs.columns == columns
    assert len(seen[0]) > len(seen[1]) >= len(seen[2]) == len(seen[3]) == len(seen[4]) > 100
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([q == (d in seen[0]) for d, q in labels.items()]) > 0.95
    same([tuple(r) for r in corpus_pipeline.run(spark, sf).collect()], [tuple(r) for r in docs.collect()])


def test_shared_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = common.written(spark.range(5), "numbers")
    assert df.count() == 5 and common.shared_path(spark, "x") != common.shared_path(spark, "x")

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda key, other=None: other)})
        sparkContext = spark.sparkContext

    assert common.shared_dir(Unset) == common.shared_dir(Unset) and common.shared_dir(Unset).startswith("file:///")
    assert spark.conf.get("spark.checkpoint.dir", None) == before
    assert common.drop_written(spark)


def test_idle_workers_give_memory_back():
    """After a task's last batch no free array of under 8 MB stays in the heap; run apart, as a worker is."""
    code = """
import re
import subprocess
import sys
import numpy as np
from vellum.llm import textkernel as K
K.lean()
def held(): return int(re.search(r"\\nPss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
def run(batches):
    for b in batches:
        arrays = [np.ones(1 << 17) for _ in range(100)]
        last = np.ones(10)
        del arrays
        yield held()
before = held()
list(K.tidy(run)([1]))
assert held() < before + 8, (before, held())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert done.returncode == 0, done.stderr

"""Posting lists, the divergence audit and centroid clustering against plain Python, on odd tables."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from vellum.llm import centroids, divergence, posting_lists

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def repeated(rows):
    return sorted(map(repr, rows))


# ---- posting lists


def vectors(n, dim, seed, odd=True):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dim) * rng.uniform(0.5, 2)).astype(np.float32).tolist(), "x") for i in range(n)]
    hot = rows[3][1]
    rows += [(100_000 + i, hot, None) for i in range(n // 3)]
    if odd:
        rows += [(5000, None, "x"), (5001, [0.0] * dim, "x"), (5002, [float("nan")] * dim, "x"), (5003, [1.0, None] + [0.0] * (dim - 2), "x"), (5004, [float("inf")] * dim, "x"), (5005, [], "x"), (None, rows[4][1], "x")]
        rows += [(6000 + i, [float(i), 1.0], "x") for i in range(7)] + [rows[7], rows[7], rows[20]]
    return rows


def brute(rows, k, asked):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for qi, q in good:
        if asked(qi):
            near = sorted((-float((q * v).sum()), i) for i, v in good if i != qi and len(v) == len(q))[:k]
            out.append([(qi, r + 1, i, -s) for r, (s, i) in enumerate(near)])
    return out


def test_small_tables_are_searched_exactly(spark):
    rows = vectors(90, 6, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = posting_lists.nearest(df, posting_lists.F.col("id") % 10 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    expected = [x for part in brute(rows, 5, lambda i: i % 10 == 0) for x in part]
    assert repeated(tuple(r) for r in got.collect()) == repeated(expected)
    assert posting_lists.nearest(df.limit(0), posting_lists.F.col("id") % 10 == 0).count() == 0


def test_many_lists_reach_the_recall_and_never_fall_short(spark):
    rows = vectors(1500, 12, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(4)
    got = posting_lists.nearest(df, posting_lists.F.expr("id % 10 = 0 AND id <> 20"), k=8, list_rows=64, group_rows=100, sample_rows=700, seeds=300).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    expected = brute(rows, 8, lambda i: i % 10 == 0 and i != 20)  # 20 is the id of two rows
    for part in expected:
        near = sorted(by[part[0][0]])
        assert [x[0] for x in near] == list(range(1, len(part) + 1))  # no list falls short, no vector takes two ranks
        assert [x[1:] for x in near] == sorted((x[1:] for x in near), key=lambda x: (-x[1], x[0]))
        left = Counter(x[1] for x in near)
        hits += sum((left & Counter(x[2] for x in part)).values())
        total += len(part)
    assert len(by) == len(expected) and hits / total >= 0.9


def test_a_query_that_finds_too_few_is_asked_again(spark):
    # a third of the rows share one id, so the lists near their queries hold only rows that do not count
    rng = np.random.default_rng(3)
    rows = [(10, (np.eye(8)[0] + 0.01 * rng.normal(size=8)).tolist()) for _ in range(300)] + [(i + 11, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = posting_lists.nearest(df, posting_lists.F.col("id") == 10, k=20, list_rows=30, sample_rows=400, seeds=100, target=0.01)
    assert {(r["query_id"], r["n"]) for r in got.groupBy("query_id").agg(posting_lists.F.count("*").alias("n")).collect()} == {(10, 300 * 20)}


def test_index_is_balanced_and_its_graph_reaches_all_lists_within_the_ratio():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    index = posting_lists.fit(0, x[:1500], float(posting_lists._norms(x).max()), 40, 10, 0.9, 1.2, 3)
    place = index.place(x)
    counts = np.bincount([p[0] for p in place], minlength=40)
    assert counts.max() < 3 * counts.mean() and 1 < np.mean([len(p) for p in place]) <= 3
    q = rng.normal(size=(200, 16))
    rows, at = index.select(q)
    d = posting_lists._distances(posting_lists.directed(q), index.centroids)
    within = np.nonzero(d <= index.ratio * d.min(axis=1, keepdims=True))
    found = set(zip(rows.tolist(), at.tolist(), strict=True))
    assert found <= set(zip(*(w.tolist() for w in within), strict=True)) and len(found) > 0.99 * len(within[0])
    none = posting_lists.fit(0, x[:10], 1.0, 40, 10, 0.9, 1.2, 3)
    assert none.lists == 1 and none.place(x[:2]) == [[0], [0]]


# ---- divergence of sources


def audited(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        sources = sorted({d[1] for d in own})
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in sources}
        whole = sum(count.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in sources:
            pairs = [(sum(abs(p(count[s], t) - p(count[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(p(count[s], t) - p(whole, t), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, t, v, r + 1) for r, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return out


def test_audit_equals_plain_counting(spark):
    rng = random.Random(5)
    vocab = ["the", "The", "é", "ÉA", "猫", "don't", "a1b", "x-y", "zz"] + ["".join(rng.choices("abcXYZ", k=3)) for _ in range(25)]
    rows = [(" ".join(rng.choices(vocab, k=rng.randint(0, 30))), rng.choice(["en", "de", None, "fr"]), rng.choice(["web", "web", "web", None, "wiki", "Ä"])) for _ in range(200)]
    rows += [rows[0]] * 30 + [(None, "en", "web"), ("", "xx", "empty"), ("only once", "yy", "a"), ("12 34", "yy", "b"), ("word " * 20_000, "en", "long")]
    wide = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, source string, term string, value int").repartition(3)
    got = divergence.audit(wide, least_docs=6, top_terms=7, salts=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert repeated(tuple(r) for r in got.collect()) == repeated(audited(rows, 6, 7))
    assert divergence.audit(wide.limit(0)).count() == 0


def test_shares_are_exact_beyond_the_range_of_a_product(spark):
    cases = [(5, 7), (9_200_000_000, 9_300_000_000), (10**12 + 7, 3 * 10**12 + 1), (5, 10**15), (10**15, 10**15)]
    got = spark.createDataFrame(cases, "a long, b long").select(divergence.share(divergence.F.col("a"), divergence.F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * a // b for a, b in cases]


# ---- centroid clustering


def clustered(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda x: (x[0] is None, sha(x[0])))[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in kept]
    total = Counter()
    for d, j in last:
        total[j] += d
    cap = lambda x: min(x, 2**63 - 1)
    return [(i, j, cap(d), cap(total[j]), cap(sum(total.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)]


@pytest.mark.parametrize("size", [1.0, 1e5, 1e9])
def test_clusters_equal_plain_rounds(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, (size * (rng.normal(size=5) + 3 * (i % 4))).tolist(), "c") for i in range(160)]
    rows += [(500 + i, rows[3][1], None) for i in range(80)] + [(700, None, "c"), (701, [1.0] * 4, "c"), (702, [float("nan")] * 5, "c"), (703, [1.0, None, 1.0, 1.0, 1.0], "c"), (704, [0.0] * 5, "c"), rows[9], rows[9]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance string").repartition(3)
    got = centroids.cluster(df, k=6, rounds=5, dim=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert repeated(tuple(r) for r in got.collect()) == repeated(clustered(rows, 6, 5, 5, 1024.0, 3))


def test_few_rows_null_ids_and_no_rows(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, 4.0]), (2, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert repeated(tuple(r) for r in centroids.cluster(df, k=8, rounds=3, dim=2).collect()) == repeated(clustered(rows, 8, 3, 2, 1024.0, 3))
    assert centroids.cluster(df.limit(0), dim=2).count() == 0


def test_bounds_save_scans_and_never_change_a_result():
    rng = np.random.default_rng(7)
    v = np.floor(1024 * (rng.normal(size=(3000, 8)) + 6 * rng.integers(0, 4, size=(3000, 1)))).astype(np.int64)
    c = v[[0, 1, 2, 3, 0]].copy()  # two centroids are equal: ties go to the smaller
    own, upper, lower, moved, scans = np.full(len(v), -1), np.full(len(v), np.inf), np.zeros(len(v)), np.zeros(5), []
    for _ in range(8):
        own, upper, lower, seen = centroids.reassign(v, own, upper, lower, c, moved)
        d2 = centroids.squared(v, c)
        assert (own == np.argmin(d2, axis=1)).all() and (upper**2 >= d2[np.arange(len(v)), own] - 1).all()
        scans.append(seen)
        new = np.stack([v[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(5)])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12)
        c = new
    assert scans[0] == len(v) and scans[-1] < len(v) / 4


def test_term_counts_by_compiled_code(spark):
    """Only A-Z is lower-cased, repeats in a text count one document, and no expression of the counts is interpreted term by term."""
    from vellum.llm.divergence import term_counts

    rows = [("Ab aB É é ΣΑΣ", "x", "s"), ("AB ab", "x", "s"), (None, "x", "s"), ("İ I", None, None)]
    found = term_counts(spark.createDataFrame(rows, "text string, lang string, source string"))
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in found.where("term <> ''").collect()}
    assert got == {("x", "s", "ab"): (4, 2), ("x", "s", "É"): (1, 1), ("x", "s", "é"): (1, 1), ("x", "s", "ΣΑΣ"): (1, 1), ("", "", "İ"): (1, 1), ("", "", "i"): (1, 1)}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()

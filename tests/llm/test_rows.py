"""Queries as registered, against brute force on the smallest tables; hot ids, clashing columns, odd tables in the stages."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from vellum.llm import bpe, chat_format, common, mixing, near_texts, quality_classifier, quality_rules, sharding, simhash, topk_search

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def queries():
    return __spark_entry__.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def words(t):
    return WORD.findall(t or "")


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_warc", "op3_topk_search", "op9_substring_dedup"])
def test_query_equals_its_sql(spark, queries, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    said = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in said.description]
    got = queries[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(said.fetchall())


def test_op4(spark, queries, documents):
    got = queries["op4_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in documents)
    n = {r.doc_id: len(words(r.text)) for r in documents}
    assert all(r.n_words == n[r.doc_id] and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    p, w, rate = np.array([r.posterior for r in got]), np.array([r.n_words for r in got]), np.array([r.rate for r in got])
    natural, reached = w @ p, (w * rate) @ p
    aim = (natural / natural.sum()) ** 0.5
    assert np.abs(reached / w.sum() - aim / aim.sum()).max() < 2e-4
    lang = sorted({r.lang for r in documents})
    at = {r.doc_id: lang.index(r.lang) for r in documents}
    assert np.mean([int(np.argmax(r.posterior)) == at[r.doc_id] for r in got if r.n_words >= 20]) > 0.97


def test_op5(spark, queries, documents):
    got = {r.doc_id: r for r in queries["op5_quality_rules"](spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        w, t, r = words(d.text), d.text or "", got[d.doc_id]
        triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = [False] * len(w)
        for k in range(len(w) - 2):
            if triples[tuple(w[k : k + 3])] > 1:
                covered[k : k + 3] = [True] * 3
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        failed = len(w) < 50 or 100 * sum(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(covered), failed)
        assert r.kept == (not failed and r.tree_score >= 0.5)


def held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = common.crc_bucket("doc_id", 5) == 0
    return docs, labels.where(~held), {r.doc_id: r.quality for r in labels.where(held).collect()}


def test_accuracy_on_held_out_labels(spark, queries):
    """op6 learns from the other labels by itself; the trees of op5 are trained on the other labels here."""
    sf = SF.replace("0.001", "0.01")
    docs, labels, truth = held_out(spark, sf)
    got = {r.doc_id: r for r in queries["op6_quality_classifier"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert len(truth) > 50 and np.mean([got[i].predicted == q for i, q in truth.items()]) > 0.95
    judged = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    assert np.mean([judged[i].kept == (q == 1) for i, q in truth.items() if not judged[i].base_failed]) > 0.9


def test_op7(spark, queries, documents):
    def fingerprint(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = sorted(documents, key=lambda r: r.doc_id)
    fps = [fingerprint(r.text) for r in docs]
    roots = components(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    expected = {(r.doc_id, f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, roots, strict=True)}
    assert {tuple(r) for r in queries["op7_simhash"](spark, SF).collect()} == expected


def test_op8(spark, queries, documents):
    import public_tokenizers

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.tokenizer_path()), special_tokens={})
    expected = set()
    for r in documents:
        ids = enc.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(r.text or "")))
    assert {tuple(r) for r in queries["op8_bpe"](spark, SF).collect()} == expected


def test_op10(spark, queries, documents):
    got = queries["op10_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1 and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(count[k])) for k in count)


def near(a, b):
    a, b = (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words((t or "").lower()) for t in (a, b)))
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline_stage_by_stage(spark, documents):
    """run() on the smallest tables against brute force, stage by stage where the stage is not trained."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.written(corpus_pipeline.quality(spark, docs, SF), "q")
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert np.mean([q == (i in {r.doc_id for r in rows}) for i, q in labels.items()]) > 0.95
    roots = components(len(rows), lambda i, j: near(rows[i].text, rows[j].text))
    one = corpus_pipeline.written(corpus_pipeline.near_duplicates(spark, kept, SF), "n")
    single = [r for i, r in enumerate(rows) if roots[i] == i]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, single))
    size = 35
    count = Counter(tuple(w[i : i + size]) for r in single for w in [words(r.text)] for i in range(len(w) - size + 1))
    cut = corpus_pipeline.written(corpus_pipeline.repeated_passages(spark, one, SF), "c")
    after = {r.doc_id: r for r in cut.collect()}
    for r in single:
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        got = after[r.doc_id]
        assert words(got.text) == [x for x, g in zip(w, gone, strict=True) if not g] and got.n_chars == len(got.text or "")
        assert any(gone) or got.text == r.text
    mixed = corpus_pipeline.written(corpus_pipeline.mixed(spark, cut, SF), "m")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) == set(after) and mixed.columns == docs.columns
    import public_tokenizers

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.tokenizer_path()), special_tokens={})
    expected = Counter()
    for i, n in copies.items():
        ids = enc.encode_ordinary(after[i].text or "")
        expected[i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(after[i].text or "")] += n
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == expected


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in all columns, empty texts, repeated rows and ids, one very long text; then an empty table."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, text(60), "en", "s", 1) for i in range(20)] + [(None, None, None, None, None), (None, "", None, "s", 0), (3, text(50), "de", "s", 5), (3, text(50), "de", None, 5), (30, text(200_000), "en", "s", 1)]
    rows += [rows[0], rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)] + [(None, 1, 0), (3, 1, 0), (4, 7, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (rows, []):
        spark.createDataFrame(table, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            own = stage(spark, docs, str(tmp_path))
            assert name == "tokens" or own.columns == docs.columns
            n = own.count()
            assert n <= len(table) if name in ("quality", "near_duplicates") else n >= len(table) if name == "mixed" else n == len(table)
            if name == "near_duplicates" and table:
                kept = own.collect()
                assert sum(r.doc_id == 3 for r in kept) == 3 and sum(r.doc_id == 0 for r in kept) == 1 and sum(not r.text for r in kept) == 1
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 if not table else True


def test_keep_one_goes_by_row(spark):
    """Rows that share an id and not their text both stay; a row whose id also stands on a duplicate stays."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(rng.choices([f"v{i}" for i in range(500)], k=40)) for _ in range(4))
    rows = [(5, a, "x"), (5, b, "y"), (3, c, "z"), (9, c, "z"), (9, d, "z"), (11, c + " end", None)]
    got = near_texts.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted(map(tuple, got)) == sorted([(5, a, "x"), (5, b, "y"), (3, c, "z"), (9, d, "z")])


def test_near_texts_with_a_large_group(spark):
    """300 copies of one text with a word or two exchanged: no pair is lost, and far fewer than all pairs are checked."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(120)] = f"x{i}-{rng.randrange(99)}"
        rows.append((i + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_texts.keep_one(docs).collect()] == [1]
    nodes = simhash.with_fingerprint(docs.withColumn("key", F.col("doc_id")), name="fp").select("key", F.lit(116).cast("long").alias("n"), "fp", F.col("key").alias("root"))
    assert near_texts._candidates(nodes, 11, 3, 80, across=False).count() <= 300 * 6


@pytest.mark.parametrize("bounds", [{}, {"most_texts": 10, "most_shingles": 4000}])
def test_groups_find_all_links(spark, bounds):
    """Links inside groups by whole sets, in one task or between blocks, against brute force."""
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 2**62, 60, dtype=np.uint64) for _ in range(3)]
    sets, groups = {}, {}
    for i in range(90):
        own = base[i % 3].copy()
        own[rng.integers(0, 60, rng.integers(1, 9))] = rng.integers(0, 2**62)
        sets[i], groups[i] = np.unique(own), i % 2
    members = spark.createDataFrame([(groups[i], i, len(x)) for i, x in sets.items()], "group long, key long, n long")
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "key long, shingles binary")
    got = near_texts._grouped_links(members, table, 80, **bounds).collect()
    alike = lambda i, j: groups[i] == groups[j] and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    told = {(min(r), max(r)) for r in got}
    assert components(90, lambda i, j: (j, i) in told) == components(90, alike)


def test_gray_orders_find_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base[:80] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 80), dtype=np.uint64), axis=0) for k in (1, 4, 7, 11, 12))]))
    expected = {(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 11}
    found = set()
    for turn in range(3):
        by = np.uint64(turn * 64 // 3)
        own = (fp << by) | (fp >> np.uint64(64 - int(by))) if by else fp
        order = np.argsort(simhash.gray_rank(own), kind="stable")
        tree = simhash.Tree(own[order], own[order])
        lead = (turn + 1) * 64 // 3 - turn * 64 // 3
        for word, member in tree.search(own, 11, lead, 3):
            found |= {(max(a, b), min(a, b)) for a, b in zip(word.tolist(), order[member].tolist(), strict=True) if a != b}
    assert found == expected


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_bits_turn_left(spark, turn):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 0x123456789ABCDEF0]
    by = turn * 64 // 3
    got = [r.x % 2**64 for r in spark.createDataFrame([(v,) for v in values], "fp long").select(simhash.rotated(F.col("fp"), by).alias("x")).collect()]
    assert got == [((v % 2**64) << by | (v % 2**64) >> 64 - by) % 2**64 for v in values]


def test_labelled_id_without_end(spark):
    """An id that occurs 100,000 times in the documents is one training row."""
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.lit("en").alias("lang")).unionByName(spark.createDataFrame([(2, "zwei und drei", "de")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in quality_rules.labelled_sample(docs, labels, "doc_id", "quality", 10).collect()) == [("text number 0", 1), ("zwei und drei", 0)]
    assert len(quality_classifier.train(docs, labels, held_out=1000).label) == 2
    mixer, table, _, _ = mixing.fit(docs, labels)
    assert mixer.domains == ("de", "en") and table.count() == 100_001


def test_many_targets(spark):
    """All of 40 domains get their targets, an unknown one is an error, and rates that can't settle are told."""
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices(chr(97 + d % 26) + chr(97 + d // 26) + "qz"[d % 2], k=5)) for _ in range(30)), f"d{d}") for i in range(1200) for d in [i % 40 if i % 3 else 0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixer, _, aim, reached = mixing.fit(docs, docs.select("doc_id"), targets={f"d{d}": 1.0 for d in range(40)})
    assert len(mixer.domains) == 40 and mixer.settled and mixer.missed < 2e-3
    assert np.abs(reached / reached.sum() - 1 / 40).max() < 2e-3 and np.allclose(aim, aim[0])
    with pytest.raises(ValueError, match="d77"):
        mixing.fit(docs, docs.select("doc_id"), targets={"d1": 1.0, "d77": 1.0})
    with pytest.warns(UserWarning, match="did not settle"):
        assert not mixing.fit(docs, docs.select("doc_id"), targets={"d1": 1.0}, rounds=1)[0].settled


def test_ids_with_a_common_end_round_apart(spark):
    docs = spark.createDataFrame([(f"{i}-same-long-ending", "a b c") for i in range(400)], "doc_id string, text string").withColumn("lang", F.lit("en"))
    mixer, table, _, _ = mixing.fit(docs, docs.select("doc_id"))
    half = mixing.replace(mixer, direction=np.array([0.5]))
    assert 120 < sum(r.copies for r in mixing.rated(table, half).collect()) < 280


def test_clashing_columns(spark):
    """Result columns replace extra columns of their names; the others come through."""
    docs = spark.createDataFrame([(1, "a b c", "en", "mine", True, 7, 8)], "doc_id long, text string, lang string, kept string, fingerprint boolean, shard int, slot int")
    forest = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    judged = quality_rules.judge(docs, forest)
    assert judged.columns.count("kept") == 1 and dict(judged.dtypes)["kept"] == "boolean" and judged.first().fingerprint is True
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"] and simhash.near_duplicates(docs).first().component_id == 1
    dealt = sharding.shuffle_into_shards(docs, shards=2)
    assert dealt.columns == ["doc_id", "text", "lang", "kept", "fingerprint", "shard", "slot"] and tuple(dealt.first())[-2:] == (0, 0)
    mixer, table, _, _ = mixing.fit(docs.withColumn("posterior", F.lit(3)).withColumn("copies", F.lit("x")), docs.select("doc_id"))
    assert mixing.rated(table, mixer).columns == ["doc_id", "n_words", "posterior", "rate", "copies"]
    scored = quality_classifier.classify(docs.withColumn("score", F.lit("x")).limit(0), quality_classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert scored.count() == 0 and dict(scored.dtypes)["score"] == "double"
    vectors = spark.createDataFrame([(1, [1.0], 2), (20, [1.0], 3)], "vec_id long, embedding array<double>, score int")
    assert [tuple(r) for r in topk_search.top_products(vectors, F.col("id") % 20 == 0).collect()] == [(20, 1, 1, 4096)]


def test_a_long_conversation(spark):
    """5,000 turns in one conversation, read back turn by turn."""
    turns = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[INST] "), F.col("id")).alias("text"))
    (got,) = chat_format.read_back(chat_format.format_log(chat_format.turns_to_log(turns))).collect()
    assert [t.text for t in got.turns] == [f"[INST] {i}" for i in range(5000)] and list(got.loss_texts) == [f"[INST] {i}" for i in range(1, 5000, 2)]


def test_the_query_log_edits_and_regenerates(spark):
    log = chat_format.turns_to_log(spark.read.parquet(f"{SF}/conversations.parquet"))
    kinds = Counter(r.kind for r in log.select("kind").collect())
    assert set(kinds) == set(chat_format.KINDS) and kinds["edit"] > 5 and kinds["regenerate"] > 5


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, other=None: other)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "app"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_scratch_tables_end(spark):
    with common.scratch(spark):
        gone, stays = common.written(spark.range(3), "gone"), common.written(spark.range(4), "stays", lasting=True)
        assert gone.count() == 3
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|does not exist|FILE"):
        gone.count()
    common.drop(stays)


def test_nearest_breaks_ties_by_place():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5], [0.1, 0.2, 0.3, 0.4]])
    assert sorted(quality_classifier._nearest(cosine, 2)[0].tolist()) == [0, 1] and sorted(quality_classifier._nearest(cosine, 2)[1].tolist()) == [2, 3]


def test_rates_are_the_fixed_point_of_a_projected_gradient_step(spark):
    rng = random.Random(9)
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx"}
    rows = [(i, " ".join("".join(rng.choices(letters[d if rng.random() < 0.8 else "aa"], k=4)) for _ in range(rng.randint(5, 60))), d) for i in range(400) for d in [rng.choice(["aa"] * 12 + ["bb"] * 5 + ["cc", "dd"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for how in ({}, {"targets": {"aa": 1.0, "bb": 0.01, "cc": 3.0, "dd": 0.5}}, {"temper": 0.3, "grow": True, "least_rate": 1.0}):
        mixer, table, aim, reached = mixing.fit(docs, docs.select("doc_id"), **how)
        got = mixing.rated(table, mixer).collect()
        p, n, r = np.array([x.posterior for x in got]), np.array([x.n_words for x in got], float), np.array([x.rate for x in got])
        assert mixer.settled and 0 < len(mixer.steps) < mixer.passes and np.allclose((n * r) @ p, reached)
        g = np.linalg.pinv((p * n[:, None]).T @ p, hermitian=True)
        after = np.maximum(mixer.least_rate, r - p @ (g @ (reached - aim)) - mixing.PULL * (r - 1))
        assert np.abs(after - r).max() < 1e-3  # one more plain step moves no rate by more


def test_control_strings_alone_are_escaped(spark):
    texts = ["a [s> b", "[/s> <INST] </INST] < s> <s", "<s></s>[INST][/INST]", "\\<s>\\", "<<s>[[INST]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.e, r.u) for r in rows.select("i", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()}
    assert got[0][0] == texts[0] and got[1][0] == texts[1] and got[2][0] == "<\\s><\\/s>[\\INST][\\/INST]"
    assert [got[i][1] for i in range(5)] == texts and not any(c in got[i][0] for i in range(5) for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_sets_with_one_key_are_told_apart(spark, monkeypatch):
    prints = spark.createDataFrame([(i, bytes([i]), 5, i % 3, 10 + i % 3, i % 3) for i in range(9)] + [(9, b"x", 6, 0, 10, 7)], f"id long, {near_texts.ROW} binary, key long, more long, n long, fp long")
    rows, distinct = near_texts._distinct(prints)
    keys = {}
    for r in rows.collect():
        keys.setdefault(r.key, set()).add((r.more, r.n) if r.id < 9 else "other")
    assert len(keys) == 4 == distinct.count() and all(len(x) == 1 for x in keys.values())

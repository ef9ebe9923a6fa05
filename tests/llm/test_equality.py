"""Words and windows that polynomial hashes modulo 2**64 can't tell apart, and rows that repeat without end."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from vellum.llm import bpe, common, docstats, substring_dedup
from vellum.llm import textkernel as K

#: The Thue-Morse word over two letters and its complement: every polynomial with an odd base modulo 2**64 is the same on both.
MORSE = "a"
for _ in range(10):
    MORSE += MORSE.translate(str.maketrans("ab", "ba"))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    rows = [(1, f"{MORSE} {OTHER}"), (2, f"x y z {MORSE} q"), (3, f"x y z {OTHER} q"), (4, MORSE), (5, OTHER)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_bpe_tells_words_apart(pair, block_bytes):
    rows, df = pair
    path = bpe.tokenizer_path()
    enc = tiktoken.Encoding("t", pat_str=bpe.tokenizer_pattern(), mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.encode(df, path, bpe.tokenizer_pattern(), block_bytes=block_bytes, bucket_words=2)
    got = {r.doc_id: bytes(r.ids) for r in coded.collect()}
    assert got == {i: np.array(enc.encode_ordinary(t), "<u4").tobytes() for i, t in rows}
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded, path).collect()} == dict(rows)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_windows_tell_words_apart(pair, block_bytes):
    _, df = pair
    got = substring_dedup.remove_repeated(df, window=5, block_bytes=block_bytes, bucket_windows=1).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    got = substring_dedup.remove_repeated(df, window=3, block_bytes=block_bytes, bucket_windows=1).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 3, 3: 3, 4: 0, 5: 0}


def test_lines_and_words_tell_apart():
    got = docstats.counts(K.column(pa.array([f"{MORSE} q\n{OTHER} q", f"{MORSE} x\n{MORSE} x", f"a b {MORSE}\na b {OTHER}"])))
    assert got["n_dup_lines"].tolist() == [0, 1, 0] and got["n_repeat_words"].tolist() == [0, 0, 0]


def test_identify_survives_colliding_hashes(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab "), 300)) + " " + MORSE for _ in range(20)]
    buf, offs = K.raw(K.column(pa.array(texts)))
    w = K.Words(buf, offs)
    own = K.ranges_hash
    monkeypatch.setattr(K, "ranges_hash", lambda b, s, e, seed=0: own(b, s, e, seed) % np.uint64(3))
    first, place, _ = K.identify(buf, w.start, w.end)
    said = [bytes(buf[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    assert [said[first[p]] for p in place] == said and len(first) == len(set(said))


def test_grouped_survives_colliding_keys(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
    monkeypatch.setattr(K, "mix", lambda x: x & np.uint64(1))
    first, place = K.grouped(a, b)
    assert (a[first][place] == a).all() and (b[first][place] == b).all() and len(first) == len({*zip(a.tolist(), b.tolist(), strict=True)})


def test_rolling_is_rabin_karp():
    v = np.random.default_rng(2).integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)
    for size in (1, 2, 3, 35, 64, 149, 150, 151):
        expected = []
        for i in range(150 - size + 1):
            h = 0
            for x in v[i : i + size].tolist():
                h = (h * K._BASE + x) % K._PRIME
            expected.append(h)
        assert K.rolling(v, size).tolist() == expected


def test_keys_travel_whole():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        high, low = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)), rng.integers(0, 2**32, n, dtype=np.uint32)
        a, b = substring_dedup._unpacked(substring_dedup._packed(high, low), n)
        assert (a == high).all() and (b == low).all()
    high, low = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32)
    assert substring_dedup._met(high, low).tolist() == [True, False, True, False]


def test_one_row_without_end(spark):
    """A row repeated 100,000 times, null ids among them, spreads over the blocks and comes back as often."""
    row = "one two three four five six seven eight nine ten"
    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(row).alias("text")).repartition(4)
    size = 100_000 * len(row)
    blocks = common.packed_blocks(many, size, 100_000)
    most = max(sum(len(common.unpacked(pa.table({"rows": pa.array([bytes(x)])}))) for x in r.rows) for r in blocks.groupBy(common.BLOCK).agg(F.collect_list("rows").alias("rows")).collect())
    assert most * len(row) < 150_000
    cut = substring_dedup.remove_repeated(many, window=5, joined=True, block_bytes=500_000)
    assert {(r.n_words, r.n_removed, r.kept_text, r["count"]) for r in cut.groupBy("n_words", "n_removed", "kept_text").count().collect()} == {(10, 10, "", 100_000)}
    path = bpe.tokenizer_path()
    coded = bpe.decode(bpe.encode(many, path, block_bytes=500_000), path, digests=True)
    assert [(r.decoded_sha256, r["count"]) for r in coded.groupBy("decoded_sha256").count().collect()] == [(hashlib.sha256(row.encode()).hexdigest(), 100_000)]


def test_messages_stay_level():
    """Rows between blocks and buckets for a GB of text: blocks a GB times buckets."""
    per_gb = [(1 << 30) / common.block_bytes_for(k) * k for k in (64, 128, 256, 512, 1024)]
    assert max(per_gb) <= 1.2 * min(per_gb)

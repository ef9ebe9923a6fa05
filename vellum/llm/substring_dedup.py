"""Removal of passages that occur more than once (Rabin-Karp windows).

Every window of `window` consecutive words of one document has a Rabin-Karp value modulo the prime 2**61 - 1 over
64-bit hashes of its words, and 32 bits of another polynomial over other hashes of them: 93 bits in all.
Rows are dealt into blocks by a hash of their place. Each block sends its distinct window keys, cut into
ranges (buckets), to the tasks that count them; the answer is one bit a key. The block then knows its repeated
windows, merges them into maximal intervals of words and cuts these out. Both reads of the blocks are one
shuffle of the texts.

Work and traffic are linear in the text: about 9 bytes a window go out and one bit comes back, whatever the number of
copies; no pair of copies is ever formed. A hot passage is one key a part of a block, so no bucket grows with its
copies, and equal rows spread over all blocks. A block grows with the number of buckets, up to 64 MB, so messages a GB stay
level up to 1,024 buckets (about 12 GB of text); beyond that raise `bucket_windows` and `block_bytes` with the executors' memory.
Two given windows that differ share a key with a chance of about 2**-93 (at most 35 * 2**-61 for the first
part by the degree of its polynomial): 1e-14 for all pairs of the windows of 100 GB of text, 1e-2 of 100 TB.

Memory: a task holds one block or one bucket (`bucket_windows`) at a time; windows are judged in parts of 512 KB of text.

Cases: null and empty texts have no words and stay empty; texts under `window` words lose nothing; very long texts are
one part; repeated rows are repeats like any other, so all their windows go; there are no ties, as all occurrences go; an
empty table gives an empty result; null ids are kept as they are. Extra columns are carried along unless a result column
has the same name, which then replaces it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import BLOCK, block_bytes_for, packed_blocks, text_bytes, unpacked

BUCKET = "__vellum_bucket"


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of their high part, then where each key stands among them and how often each occurs."""
    first, place = K.grouped(high, low)
    order = np.lexsort((low[first], high[first]))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    place = back[place]
    return high[first][order], low[first][order], place, np.bincount(place, minlength=len(first))


def _cuts(high: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits buckets begins among ascending keys, and the end."""
    inner = np.searchsorted(high, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(high)]])


def _packed(high: np.ndarray, low: np.ndarray) -> bytes:
    """Keys as differences of neighbours, whose upper bytes are mostly zero and thus compressed."""
    step = np.diff(high, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    upper = zstandard.compress(np.ascontiguousarray(step[:, 5:].T).tobytes(), 1)
    return len(upper).to_bytes(8, "little") + upper + np.ascontiguousarray(step[:, :5]).tobytes() + low.astype("<u4").tobytes()


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = 8 + int.from_bytes(data[:8], "little")
    step = np.empty((n, 8), np.uint8)
    step[:, 5:] = np.frombuffer(zstandard.decompress(data[8:at]), np.uint8).reshape(3, n).T
    step[:, :5] = np.frombuffer(data, np.uint8, 5 * n, at).reshape(n, 5)
    return np.cumsum(step.view("<u8")[:, 0]), np.frombuffer(data, "<u4", n, at + 5 * n)


def _met(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(high, kind="stable")
    even = high[order[1:]] == high[order[:-1]]
    if (even & (low[order[1:]] != low[order[:-1]])).any():
        order = np.lexsort((low, high))
    same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    out = np.zeros(len(high), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _intervals(words: K.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of removed words inside documents: first word, word after the last, document."""
    n, doc = len(gone), words.doc
    if not n:
        return (np.zeros(0, np.int64),) * 3
    new, last = gone.copy(), gone.copy()
    same = doc[1:] == doc[:-1]
    new[1:] &= ~(gone[:-1] & same)
    last[:-1] &= ~(gone[1:] & same)
    begin = np.flatnonzero(new)
    return begin, np.flatnonzero(last) + 1, doc[begin]


def _cut(words: K.Words, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without the intervals, each with the space up to the next word, and document offsets."""
    to = words.offs[doc + 1].copy()
    after = end < words.first[doc + 1]
    to[after] = words.start[end[after]]
    edge = np.zeros(len(words.buf) + 1, np.int32)
    np.add.at(edge, words.start[begin], 1)
    np.add.at(edge, to, -1)
    stays = np.cumsum(edge[:-1]) == 0
    sums = np.zeros(len(words.buf) + 1, np.int64)
    np.cumsum(stays, out=sums[1:])
    return words.buf[stays], sums[words.offs]


def _strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ChunkedArray:
    return pa.chunked_array([pa.Array.from_buffers(pa.large_string(), len(o) - 1, [None, pa.py_buffer(np.ascontiguousarray(o, np.int64)), pa.py_buffer(b.tobytes())]).cast(pa.string()) for b, o in parts], pa.string())


def remove_repeated(docs: DataFrame, text: str = "text", window: int = 35, joined: bool = False, block_bytes: int | None = None, bucket_windows: int = 1 << 21, settled: bool = False) -> DataFrame:
    """Rows of `docs` with n_words, n_removed, removed (word intervals [begin, end) from 0) and kept_text.

    kept_text keeps the space between words as it was; joined=True joins the kept words by one space. settled: `docs` is a
    plain scan of files, so it need not be written before it is dealt.
    """
    docs = docs.drop("n_words", "n_removed", "removed", "kept_text")
    _, size = text_bytes(docs, text)
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / bucket_windows)))))
    dealt = packed_blocks(docs, size, block_bytes or block_bytes_for(1 << bits), settled)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(1 << bits)]
        for _, part in K.slices(K.column(unpacked(table).column(text))):
            _, high, low = K.words_of(part).windows(window)
            high, low, _, _ = _distinct(high, low)
            cuts = _cuts(high, bits).tolist()
            for own, a, b in zip(sent, cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    own.append((high[a:b], low[a:b]))
        some = [(i, *map(np.concatenate, zip(*own, strict=True))) for i, own in enumerate(sent) if own]
        return pa.table({BUCKET: pa.array([i for i, _, _ in some], pa.int32()), BLOCK: pa.array([key[0].as_py()] * len(some), pa.int32()), "n": pa.array([len(h) for _, h, _ in some], pa.int32()), "keys": pa.array([_packed(h, x) for _, h, x in some], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        K.lean()
        sizes = table.column("n").to_pylist()
        sent = [_unpacked(x.as_buffer().to_pybytes(), n) for x, n in zip(table.column("keys"), sizes, strict=True)]
        seen = _met(*map(np.concatenate, zip(*sent, strict=True)))
        flags = np.split(seen, np.cumsum(sizes)[:-1])
        return pa.table({BLOCK: table.column(BLOCK), BUCKET: table.column(BUCKET), "n": table.column("n"), "bits": pa.array([np.packbits(x).tobytes() for x in flags], pa.binary())})

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("kept_text", T.StringType())])

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        table = unpacked(table)
        begin = np.zeros((1 << bits) + 1, np.int64)
        begin[1 + told.column(BUCKET).to_numpy()] = told.column("n").to_numpy()
        begin = np.cumsum(begin)  # the answers, bucket by bucket; `used` of each are taken
        seen, used = np.zeros(begin[-1], bool), np.zeros(1 << bits, np.int64)
        for i, n, x in zip(told.column(BUCKET).to_pylist(), told.column("n").to_pylist(), told.column("bits"), strict=True):
            seen[begin[i] : begin[i + 1]] = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n)
        n_words, n_removed, spans, texts = [], [], [], []
        for _, part in K.slices(K.column(table.column(text))):
            words = K.words_of(part)
            at, high, low = words.windows(window)
            high, low, place, count = _distinct(high, low)
            size = np.diff(_cuts(high, bits))
            again = (seen[K.spread(begin[:-1] + used, size)] | (count > 1))[place]
            used += size
            gone = words.covered(at[again], window)
            first, last, doc = _intervals(words, gone)
            n_words.append(words.count)
            n_removed.append(words.per_doc(gone))
            base = words.first[doc]
            ends = np.searchsorted(doc, np.arange(len(words.count) + 1)).astype(np.int32)
            both = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["begin", "end"])
            spans.append(pa.ListArray.from_arrays(pa.array(ends), both))
            texts.append(words.joined(~gone)[:2] if joined else _cut(words, first, last, doc))
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        out = table
        for name, col in (("n_words", flat(n_words)), ("n_removed", flat(n_removed)), ("removed", pa.chunked_array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))), ("kept_text", _strings(texts))):
            out = out.append_column(name, col)
        return out

    keys = dealt.groupBy(BLOCK).applyInArrow(K.tidy(ask), f"{BUCKET} int, {BLOCK} int, n int, keys binary")
    told = keys.groupBy(BUCKET).applyInArrow(K.tidy(answer), f"{BLOCK} int, {BUCKET} int, n int, bits binary")
    return dealt.groupBy(BLOCK).cogroup(told.groupBy(BLOCK)).applyInArrow(K.tidy(cut), schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated(docs, joined=True, settled=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

"""Byte-level BPE with each distinct word encoded once.

Rows are dealt into blocks of a few MB of text by a hash of their place. A block splits its texts into pre-tokens, keeps their
positions, and sends its distinct pre-tokens by hash to the tasks that merge; there the lists of
all blocks meet, each distinct word is encoded once, and the ids go back to the blocks that asked.
The block puts them at the positions of its pre-tokens. Both reads of the blocks are one shuffle of
the texts, and the positions are found again by the same split rather than sent; the words that travel are a block's
distinct ones, compressed, so a very common word costs one entry a block. Words are told apart by their bytes: hashes
only propose which are equal. Decoding looks ids up in the token-byte table, whose size is that of the
vocabulary: 50,000 entries in each worker, which a join would have to broadcast as well.

Memory: a task holds one block or one bucket of words (`bucket_words`). A block grows with the number of
buckets up to 64 MB, so messages a GB stay level up to 1,024 buckets; beyond that raise `bucket_words` and `block_bytes`.

Cases: null and empty texts have no ids and decode to empty bytes; a text that is one very long pre-token is one
word; repeated rows each come back; there are no ties; an empty table gives an empty one. Extra columns are carried along
unless a result column has the same name, which then replaces it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import BLOCK, block_bytes_for, packed_blocks, text_bytes, unpacked

BUCKET = "__vellum_bucket"
#: Fixed value: the split pattern for which the runs of character classes below stand.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, WHITE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the tokeniser's own pattern engine tells it."""
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, one in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        enc = tiktoken.Encoding("class", pat_str=one, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for start in range(0, 0x110000, 0x1000):
            some = "".join(chr(x) for x in range(start, start + 0x1000) if not 0xD800 <= x < 0xE000)
            found = bytes(enc.encode_ordinary(some)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def _run_starts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of RUNS, and the first pre-token of each document."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = classes()[cp]
    doc = np.searchsorted(at, offs)
    fresh = np.zeros(n + 1, bool)
    fresh[doc] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # what follows a character within its document, and what precedes it
    follow = np.full(n, 255, np.uint8)
    follow[:-1] = np.where(fresh[1:n], 255, kind[1:])
    blank = cp == 0x20
    led = np.zeros(n, bool)
    led[1:] = blank[:-1] & ~fresh[1:n] & (kind[1:] != WHITE)
    start &= ~led
    start |= (kind == WHITE) & ~run & (follow < WHITE)
    mark = np.flatnonzero((cp == 0x27) & run & ~led & (follow == LETTER))
    if len(mark):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        one, two = pad[mark + 1], pad[mark + 2]
        within = ~fresh[np.minimum(mark + 2, n)] & (mark + 2 < n)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = within & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for some, size in ((mark[short], 2), (mark[long], 3)):
            start[some + 1] = False
            rest = some + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~fresh[rest]]] = True
    start = np.flatnonzero(start)
    return at[start], np.searchsorted(start, doc)


def _pattern_starts(buf: np.ndarray, offs: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by a regular expression, for any other pattern; with ends."""
    split, begin, end, first = regex.compile(pattern), [], [], [0]
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        text, at, char = buf[a:b].tobytes().decode(), a, 0
        for m in split.finditer(text):
            at += len(text[char : m.start()].encode())
            begin.append(at)
            at += len(m.group().encode())
            end.append(at)
            char = m.end()
        first.append(len(begin))
    return np.array(begin, np.int64), np.array(end, np.int64), np.array(first)


def pretokens(buf: np.ndarray, offs: np.ndarray, pattern: str = RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the matches of the pattern, and the first match of each document."""
    if pattern != RUNS:
        return _pattern_starts(buf, offs, pattern)
    start, first = _run_starts(buf, offs)
    return start, np.append(start[1:], len(buf)) if len(start) else start, first


class _Block:
    """The pre-tokens of one block: distinct words in hash order, and for each part of the texts which of them stands where."""

    def __init__(self, texts: pa.Array, pattern: str):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        known = 0
        for _, part in K.slices(texts):
            buf, offs = K.raw(part)
            start, end, at = pretokens(buf, offs, pattern)
            first, place, _ = K.identify(buf, start, end)
            size = end[first] - start[first]
            self.parts.append((at, (place + known).astype(np.int32)))
            sizes.append(size)
            words.append(buf[K.spread(start[first], size)])
            known += len(first)
        # the words of all parts once more, as parts share many
        size, data = np.concatenate(sizes), np.concatenate(words)
        end = np.cumsum(size)
        first, place, key = K.identify(data, end - size, end)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.rank = rank[place]
        self.hash, first = key[order], first[order]
        self.size = size[first]
        self.bytes = data[K.spread((end - size)[first], self.size)]

    def lists(self, bits: int):
        """(bucket, word sizes, bytes) of the distinct words, by hash range."""
        cuts = np.searchsorted(self.hash, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
        cuts = [0, *cuts.tolist(), len(self.hash)]
        ends = np.cumsum([0, *self.size.tolist()])
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                yield i, self.size[a:b], self.bytes[ends[a] : ends[b]]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x.as_buffer()), kind)


def encode(docs: DataFrame, path: str, pattern: str = RUNS, text: str = "text", block_bytes: int | None = None, bucket_words: int = 1 << 18, carry_text: bool = False, settled: bool = False) -> DataFrame:
    """Rows of `docs`, without the text, with n_tokens and ids (32-bit little-endian unsigned integers, packed).
    settled: `docs` is a plain scan of files, so it need not be written before it is dealt."""
    docs = docs.drop("n_tokens", "ids")
    _, size = text_bytes(docs, text)
    bits = max(0, int(np.ceil(np.log2(max(1, size / 50 / bucket_words)))))
    dealt = packed_blocks(docs, size, block_bytes or block_bytes_for(1 << bits), settled)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = [(i, _pack(s.astype(np.uint32)), _pack(b)) for i, s, b in _Block(K.column(unpacked(table).column(text)), pattern).lists(bits)]
        return pa.table({BUCKET: pa.array([x[0] for x in sent], pa.int32()), BLOCK: pa.array([key[0].as_py()] * len(sent), pa.int32()), "sizes": pa.array([x[1] for x in sent], pa.binary()), "words": pa.array([x[2] for x in sent], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        K.lean()
        enc, known, sizes, ids = encoding(path, pattern), {}, [], []
        for s, w in zip(table.column("sizes"), table.column("words"), strict=True):
            data, ends = _unpack(w, np.uint8).tobytes(), np.cumsum(_unpack(s, np.uint32), dtype=np.int64).tolist()
            own, a = [], 0
            for b in ends:
                word = data[a:b]
                if (x := known.get(word)) is None:
                    x = known[word] = np.array(enc._encode_single_piece(word), np.uint32).tobytes()
                own.append(x)
                a = b
            sizes.append(_pack(np.fromiter(map(len, own), np.uint32, len(own)) // np.uint32(4)))
            ids.append(_pack(np.frombuffer(b"".join(own), np.uint32)))
        return pa.table({BLOCK: table.column(BLOCK), BUCKET: table.column(BUCKET), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    keep = [f for f in docs.schema.fields if carry_text or f.name != text]

    def put(table: pa.Table, told: pa.Table) -> pa.Table:
        table = unpacked(table)
        block = _Block(K.column(table.column(text)), pattern)
        order = np.argsort(told.column(BUCKET).to_numpy(), kind="stable").tolist()
        size = np.concatenate([np.zeros(0, np.uint32), *(_unpack(told.column("sizes")[i], np.uint32) for i in order)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *(_unpack(told.column("ids")[i], np.uint32) for i in order)])
        start, offs, packed, at = np.cumsum(size) - size, [np.zeros(1, np.int64)], [b""], 0
        for first, place in block.parts:
            place = block.rank[place]
            ends = np.zeros(len(place) + 1, np.int64)
            np.cumsum(size[place], out=ends[1:])
            packed.append(ids[K.spread(start[place], size[place])].tobytes())
            offs.append(ends[first[1:]] + at)
            at += ends[-1]
        offs = np.concatenate(offs)
        data = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs * 4), pa.py_buffer(b"".join(packed))]).cast(pa.binary())
        return pa.table([*[table.column(f.name) for f in keep], pa.array(np.diff(offs)), data], names=[*[f.name for f in keep], "n_tokens", "ids"])

    words = dealt.groupBy(BLOCK).applyInArrow(K.tidy(ask), f"{BUCKET} int, {BLOCK} int, sizes binary, words binary")
    told = words.groupBy(BUCKET).applyInArrow(K.tidy(merge), f"{BLOCK} int, {BUCKET} int, sizes binary, ids binary")
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return dealt.groupBy(BLOCK).cogroup(told.groupBy(BLOCK)).applyInArrow(K.tidy(put), schema)


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and start and size of each id."""
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(x) for x in ranks]
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8), np.cumsum(size) - size, size


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded", digests: bool = False) -> DataFrame:
    """Rows of `coded` without ids, with the bytes that the ids stand for; digests=True: instead with
    ids_sha256 and decoded_sha256, lower-case hex. Null ids stand for none."""
    keep = [f for f in coded.schema.fields if f.name not in (ids, out)]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        K.lean()
        data, start, size = token_bytes(path)
        for batch in batches:
            found, packed = [], batch.column(ids)
            packed = [x.as_buffer() if x.is_valid else b"" for x in packed]
            at = 0
            while at < len(packed):
                to, n = at, 0
                while to < len(packed) and (to == at or n + len(packed[to]) < 1 << 20):
                    n, to = n + len(packed[to]), to + 1
                own = np.frombuffer(b"".join(packed[at:to]), "<u4")
                text = data[K.spread(start[own], size[own])].tobytes()
                ends = np.zeros(len(own) + 1, np.int64)
                np.cumsum(size[own], out=ends[1:])
                cut = ends[np.cumsum([0, *(len(x) // 4 for x in packed[at:to])])].tolist()
                found.extend(text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
                if digests:
                    found[at:] = map(sha, found[at:])
                at = to
            cols = [pa.array(list(map(sha, packed)), pa.string()), pa.array(found, pa.string())] if digests else [pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *cols], names=[*[f.name for f in keep], *(["ids_sha256", "decoded_sha256"] if digests else [out])])

    more = [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField(out, T.BinaryType())]
    return coded.mapInArrow(K.tidy(run), T.StructType([*keep, *more]))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = tokenizer_path()
    return decode(encode(docs, path, tokenizer_pattern(), settled=True), path, digests=True)

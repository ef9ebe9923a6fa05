"""NumPy kernels over the bytes of Arrow text columns.

A column of texts is one byte buffer with document offsets. Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D that lie inside one document. Equal byte ranges are found by a hash and then
compared byte by byte with the first of their kind (`identify`), so equality is never a matter of chance. Windows that
must be compared between tasks have keys of two independent parts: a Rabin-Karp value modulo the prime
2**61 - 1, and 32 bits of another polynomial over other word hashes. Null texts are empty texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_STEP, _SIZE = U64(0x9E3779B97F4A7C15), U64(0x9FB21C651E98DF25)
#: Multipliers of the two window polynomials: modulo 2**61 - 1, and modulo 2**64 (odd).
_PRIME, _BASE, _WORD_BASE = (1 << 61) - 1, 0x1A3C5E9D7B2F4861 % ((1 << 61) - 1), 0xD6E8FEB86659FD93 | 1
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: The low k bytes of a lane of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Ranges of more bytes are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


_WORD_INV = pow(_WORD_BASE, -1, 1 << 64)


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + size - 1."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def ranges_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step; a step is a permutation of what it adds, so ranges of equal
    size that differ in one lane always differ. Long ranges are hashed by XXH3."""
    lanes, size = _lanes(buf), end - start
    h = mix(size.astype(U64) * _SIZE + U64(seed))
    live = np.flatnonzero(size <= _LONG) if len(size) and size.max() > _LONG else np.arange(len(size))
    at, left = start[live], size[live]
    while len(live):
        more = lanes[at] & _LOW[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ more) * _STEP)
        on = np.flatnonzero(left > 8)
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes(), seed)
    return h


def identify(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, place, hash): place numbers the byte ranges so that equal numbers mean equal bytes; first is the first
    range of each number. Hashes only propose: all ranges are compared with the first of their number."""
    hashes = ranges_hash(buf, start, end)
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    size, rep = end - start, first[place]
    more = np.flatnonzero(rep != np.arange(len(rep)))
    lanes, one = _lanes(buf), rep[more]
    low = _LOW[np.minimum(size[more], 8)]
    same = (size[more] == size[one]) & ((lanes[start[more]] ^ lanes[start[one]]) & low == 0)
    wide = np.flatnonzero(same & (size[more] > 8))
    if len(wide):
        n = size[more[wide]]
        differ = buf[spread(start[more[wide]], n)] != buf[spread(start[one[wide]], n)]
        same[wide] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
    if not same.all():
        known: dict[tuple[int, bytes], int] = {}
        firsts = []
        for i in more[~same].tolist():
            word = (int(hashes[i]), buf[start[i] : end[i]].tobytes())
            if word not in known:
                known[word] = len(first) + len(firsts)
                firsts.append(i)
            place[i] = known[word]
        first = np.concatenate([first, np.array(firsts, first.dtype)])
    return first, place, hashes[first]


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place) of the rows of some whole-number columns: equal rows have equal places."""
    key = np.zeros(len(columns[0]), U64)
    for c in columns:
        key = mix((key ^ c.astype(U64)) * _STEP + _SIZE)
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    rep = first[place]
    if all((c[rep] == c).all() for c in columns):
        return first, place
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(_PRIME)) + (x >> U64(61))
    return np.where(x >= U64(_PRIME), x - U64(_PRIME), x)


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2**61 - 1, for x and c below it."""
    low = U64((1 << 31) - 1)
    xh, xl, ch, cl = x >> U64(31), x & low, U64(c >> 31), U64(c & (1 << 31) - 1)
    mid = xh * cl + xl * ch
    return _reduced(((xh * ch) << U64(1)) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + xl * cl)


def rolling(v: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp values modulo 2**61 - 1 of all windows of `size` values, by doubling."""
    run, have, out, width = _reduced(v), 1, None, 0
    while True:
        if size & have:
            n = max(0, len(v) - width - have + 1)
            out = run[:n] if out is None else _reduced(_times(run[:n], pow(_BASE, width, _PRIME)) + out[have : have + n])
            width += have
        if width == size:
            return out
        n = max(0, len(run) - have)
        run, have = _reduced(_times(run[:n], pow(_BASE, have, _PRIME)) + run[have : have + n]), 2 * have


@lru_cache(1)
def lean() -> None:
    """From now on this worker gives large arrays back to the system as soon as they are free, so that idle
    workers, which Spark keeps beside the busy ones, hold little."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 23)  # from this size on an array has a mapping of its own; fresh mappings cost a fault a page
        libc.mallopt(-1, 1 << 25)  # free memory at the heap's end that may stay
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Gives the heap's free memory back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(of: Callable, least: int = 1 << 20) -> Callable:
    """`of`, a function of batches, or of one or two tables of a group, that trims when a task's batches or a group of at least
    `least` bytes are done: Spark keeps idle workers, whose free memory else adds up beside the busy ones."""
    if inspect.isgeneratorfunction(of):

        def run(batches):
            yield from of(batches)
            trim()

        return run

    def called(*tables):
        out = of(*tables)
        if sum(x.nbytes for x in tables if isinstance(x, pa.Table)) >= least:
            trim()
        return out

    # the number of arguments tells Spark what to pass
    return (lambda table: called(table)) if len(inspect.signature(of).parameters) == 1 else (lambda one, two: called(one, two))


def column(arr) -> pa.Array:
    """One contiguous string array without nulls."""
    lean()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.cast(pa.large_string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (from 0) of a column()."""
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(arr: pa.Array, most: int = 1 << 19, rows: int = 1 << 16) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column() of at most about `most` bytes and `rows` rows, one document at least; with the first row."""
    _, offs = raw(arr)
    at, n = 0, len(arr)
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1))
        yield at, arr.slice(at, to - at)
        at = to


class Words:
    """The words of some documents: byte ranges, and where each document's words begin."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        space = SPACE[buf]
        solid = ~space
        begin, end = solid.copy(), solid.copy()
        if len(buf):
            begin[1:] &= space[:-1]
            end[:-1] &= space[1:]
            edge = offs[:-1][offs[:-1] < offs[1:]]
            begin[edge] = solid[edge]
            last = offs[1:][offs[:-1] < offs[1:]] - 1
            end[last] = solid[last]
        self.solid = solid
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self._ids: tuple[np.ndarray, int] | None = None

    def hash(self, seed: int = 0) -> np.ndarray:
        return ranges_hash(self.buf, self.start, self.end, seed)

    @property
    def ids(self) -> tuple[np.ndarray, int]:
        """A number for each word, the same for equal words only, and how many numbers there are."""
        if self._ids is None:
            first, place, _ = identify(self.buf, self.start, self.end)
            self._ids = place, len(first)
        return self._ids

    @property
    def again(self) -> np.ndarray:
        """Which words equal the word before them in their document."""
        ids, doc = self.ids[0], self.doc
        out = np.zeros(len(ids), bool)
        out[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
        return out

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def starts(self, size: int) -> np.ndarray:
        """The first words of all windows of `size` words inside one document."""
        return np.flatnonzero(np.arange(len(self.start)) + size <= np.repeat(self.first[1:], self.count))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of all windows, and their keys: 64 bits from 61 modulo the prime, and 32 of another polynomial."""
        at, n = self.starts(size), len(self.start)
        high = mix(rolling(self.hash(), size)[at])
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.hash(0x5851F42D) * powers(_WORD_BASE, n), out=sums[1:])
        low = mix((sums[at + size] - sums[at]) * powers(_WORD_INV, n + 1)[at]) >> U64(32)
        return at, high, low.astype(np.uint32)

    def covered(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which words lie in one of the windows that start at `at`."""
        n = len(self.start)
        step = np.bincount(at, minlength=n + size)
        step[size:] -= step[:-size].copy() if size < len(step) else 0
        return np.cumsum(step)[:n] > 0

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per word over each document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def joined(self, keep: np.ndarray | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kept words joined by one space: bytes, document offsets, mask of the bytes taken."""
        buf, n = self.buf, len(self.start)
        if keep is None:
            keep = np.ones(n, bool)
        solid = self.solid.copy()
        if not keep.all():
            edge = np.zeros(len(buf) + 1, np.int8)
            edge[self.start[~keep]] += 1
            edge[self.end[~keep]] -= 1
            solid &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        kept = np.flatnonzero(keep)
        doc = self.doc[kept]
        more = np.zeros(len(kept), bool)
        if len(kept) > 1:
            more[:-1] = doc[1:] == doc[:-1]
        gap = self.end[kept[more]]
        solid[gap] = True
        out = buf.copy()
        out[gap] = 0x20
        if lower:
            big = (out >= 0x41) & (out <= 0x5A)
            out[big] += 32
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(solid, out=sums[1:])
        return out[solid], sums[self.offs], solid


def words_of(arr: pa.Array) -> Words:
    return Words(*raw(arr))

"""Statistics of whole texts, as arrays with one value a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkernel as K

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_IS = {
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "upper": (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A),
    "lower": (np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A),
    "digit": (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39),
    "stop": np.isin(np.arange(256), list(b".,;:!?")),
    "line": np.arange(256) == 10,
}


def _sum(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _duplicate_lines(words: K.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    buf, offs = words.buf, words.offs
    full = offs[:-1] < offs[1:]
    brk = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offs[:-1][full], brk + 1]), kind="stable")
    end = np.sort(np.concatenate([offs[1:][full], brk]), kind="stable")
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(words.solid, out=solid[1:])
    some = solid[end] > solid[start]
    start, end = start[some], end[some]
    doc = np.searchsorted(offs, start, "right") - 1
    first, place = K.grouped(doc, K.identify(buf, start, end)[1])
    return np.bincount(doc[first[place] != np.arange(len(doc))], minlength=len(offs) - 1)


def _repeat_words(words: K.Words, size: int = 3) -> np.ndarray:
    """Words in windows of `size` words that stand twice or more in their text, the first included."""
    at, ids = words.starts(size), words.ids[0]
    _, place = K.grouped(words.doc[at], *(ids[at + i] for i in range(size)))
    return words.per_doc(words.covered(at[np.bincount(place)[place] > 1], size))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars", "n_upper", "n_lower", "n_digits", "n_stops", "n_lines", "n_short", "n_same")


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA of a text column; all zero for null and empty texts, but for their one line."""
    parts = []
    for _, part in K.slices(texts):
        w = K.words_of(part)
        lead = (w.buf & 0xC0) != 0x80
        parts.append({
            "n_words": w.count, "word_chars": _sum(lead & w.solid, w.offs), "n_symbols": _sum(_IS["symbol"][w.buf], w.offs),
            "n_dup_lines": _duplicate_lines(w), "n_repeat_words": _repeat_words(w),
            "n_chars": _sum(lead, w.offs), "n_upper": _sum(_IS["upper"][w.buf], w.offs), "n_lower": _sum(_IS["lower"][w.buf], w.offs),
            "n_digits": _sum(_IS["digit"][w.buf], w.offs), "n_stops": _sum(_IS["stop"][w.buf], w.offs), "n_lines": _sum(_IS["line"][w.buf], w.offs) + 1,
            "n_short": w.per_doc(w.end - w.start == 1), "n_same": w.per_doc(w.again),
        })
    return {k: np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int64) for k in (*COUNTS, *EXTRA)}

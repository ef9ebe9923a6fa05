"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The trees are grown here, on the driver, from a bounded sample of labelled rows (`train_rows`, the
smallest by hash of the id), with histograms, logistic loss and monotonic constraints. The forest is
then five NumPy arrays (feature, threshold, children, value); a batch of documents walks all
trees level by level. Statistics cover whole texts; scoring is one pass without a shuffle.

Cases: null and empty texts have no words and fail the base rules; very long texts are counted whole, one part of a
batch each; with no usable label (0 or 1), or labels of one kind, the trees accept everything that passes the base rules; an id
repeated in the labels counts once (the lower label), in the documents once (the least text); scores that tie with the threshold
are kept; repeated rows each come back; an empty table gives an empty one. Extra columns are carried along unless a
result column has the same name, which then replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import docstats
from . import textkernel as K
from .common import one_text

#: Features, each with its constraint: the score may only fall (-1) as it rises, or is free (0).
FEATURES = {"symbols_per_word": -1, "repeat_share": -1, "same_share": -1, "dup_line_share": -1, "upper_share": -1, "short_share": -1, "digit_share": 0, "stops_per_word": 0, "word_length": 0, "words_per_line": 0, "log_words": 0}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(1, c["n_words"]), np.maximum(1, c["word_chars"])
    return np.stack([c["n_symbols"] / words, c["n_repeat_words"] / words, c["n_same"] / words, c["n_dup_lines"] / c["n_lines"], c["n_upper"] / np.maximum(1, c["n_upper"] + c["n_lower"]), c["n_short"] / words, c["n_digits"] / chars, c["n_stops"] / words, c["word_chars"] / words, words / c["n_lines"], np.log1p(c["n_words"])], axis=1)


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays; node i of a leaf is its own child. roots: first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Second-order boosting of log loss. A split must keep the sign of its feature, and the middle
    of its two values bounds all values below, so each tree is monotonic and so is their sum."""
    share = np.clip(y.mean() if len(y) else 1.0, 0.001, 0.999)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(set(y.tolist())) > 1:
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)

            def grow(rows: np.ndarray, left: int, low: float, high: float, g=g, h=h) -> int:
                me = len(nodes)
                value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
                nodes.append([0, np.inf, me, me, rate * value])
                best = (1e-6, 0, 0, 0.0, 0.0)
                if left and len(rows) >= 2 * least:
                    for f, cut in enumerate(cuts):
                        if not len(cut):
                            continue
                        b = binned[rows, f]
                        gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cut) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
                        vl, vr = np.clip(gs / (hs + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                        gain = 2 * (gs * vl + gr * vr) - (hs + ridge) * vl**2 - (hr + ridge) * vr**2 - 2 * g[rows].sum() * value + (h[rows].sum() + ridge) * value**2
                        gain[(ns < least) | (len(rows) - ns < least) | (signs[f] * (vr - vl) < 0)] = -1
                        if gain.max(initial=-1) > best[0]:
                            i = int(gain.argmax())
                            best = (gain[i], f, i, vl[i], vr[i])
                if best[0] > 1e-6:
                    _, f, i, vl, vr = best
                    mid, at = (vl + vr) / 2, binned[rows, f] <= i
                    bound = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
                    a = grow(rows[at], left - 1, *bound[0])
                    b = grow(rows[~at], left - 1, *bound[1])
                    nodes[me] = [f, cuts[f][i], a, b, 0.0]
                return me

            roots.append(grow(np.arange(len(y)), depth, -np.inf, np.inf))
            own = Forest(np.array(roots[-1:]), *_arrays(nodes), depth, 0.0)
            s = np.clip(own.score(x), 1e-12, 1 - 1e-12)
            margin += np.log(s / (1 - s))
    return Forest(np.array(roots, int), *_arrays(nodes), depth, base)


def _arrays(nodes: list) -> tuple[np.ndarray, ...]:
    return tuple(np.array([n[i] for n in nodes], kind) for i, kind in enumerate((int, float, int, int, float)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label: str, rows: int, text: str = "text") -> DataFrame:
    """(text, __label) of at most `rows` labelled ids, the smallest by hash: one row an id, that of the least text."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).cast("int").alias("__label"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return one_text(docs.select(id_col, text).join(F.broadcast(ids), id_col), id_col, text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = 4000, **how) -> Forest:
    def run(batches):
        for b in batches:
            x = features(docstats.counts(K.column(b.column(text))))
            yield pa.RecordBatch.from_arrays([b.column("__label"), *map(pa.array, x.T)], names=["__label", *FEATURES])

    sample = labelled_sample(docs, labels, id_col, label, train_rows, text)
    got = sample.mapInArrow(run, "__label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit(got[list(FEATURES)].to_numpy(), got["__label"].to_numpy(float), list(FEATURES.values()), **how)


def judge(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.5, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Rows of `docs` without the text, with the statistics, base_failed, tree_score and kept."""
    more = [*(T.StructField(c, T.LongType()) for c in docstats.COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("tree_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    keep = [f for f in docs.schema.fields if f.name not in {text, *(m.name for m in more)}]

    def run(batches):
        for b in batches:
            c = docstats.counts(K.column(b.column(text)))
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > repeat_percent * c["n_words"])
            score = forest.score(features(c))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *[pa.array(c[k]) for k in docstats.COUNTS], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=[*[f.name for f in keep], *[m.name for m in more]])

    return docs.mapInArrow(run, T.StructType([*keep, *more]))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

"""Mixing sources to target weights by soft membership.

A softmax classifier over byte-pair shares, fitted on a bounded sample of the labelled table (`train_rows` ids, the
smallest by hash, one row an id), gives each document a posterior over domains. Document i with n_i words then holds
n_i * p_id expected words of domain d. Rates r_i >= least_rate minimise, with residuals e = (sum_i r_i * n_i * p_i) - target and the
Gram matrix G = sum_i n_i * p_i p_i^T, the least squares e^T G^-1 e + 1e-5 * sum_i n_i * (r_i - 1)**2 by projected gradient steps,
scaled by the words of each document: r_i becomes max(least_rate, r_i - s * (p_i . G^-1 e + 1e-5 * (r_i - 1))). In these terms the first part has no
curvature but 0 and 1, so with s = 1 / (1 + 1e-5) every step descends, and one meets the targets where no rate is at its bound. Where
many are, steps from r = 1 are slow; so they start from r_i = max(least_rate, 1 - p_i . d) with one direction d for all, which Newton steps on
the dual bring near the fixed point. Steps end when none moves a rate by more than `still`; the longest move of the last one is reported as `moved`.

A step needs one pass over a narrow written table (id, words, posterior) that adds the words of each domain. Rates are never stored
or shuffled: a step is the same for all documents but for their posteriors, so D numbers a step give any later pass over the texts the rates
again. The driver holds D * D numbers once and D an iteration.

The domain is any column. A classifier of texts can only move what texts show: where a column does not depend on
the text, as `source` in the test tables, posteriors are flat and the rates stay level.

Cases: null and empty texts have no words and a uniform posterior of no weight; very long texts are one part of a
batch; with no usable domain labels all documents are one domain; a target for a domain that the labelled sample does not hold
raises ValueError; null ids and repeated rows are rows like any other, rows with one id share their rounding; there are no ties but among
labelled ids, which hash and id order; an empty table gives an empty one; where the targets can't all be met (least_rate too
high), the rates are a least-squares compromise. `Mixer.missed` is the largest miss as a share of all words and
`Mixer.settled` says whether the steps ended by themselves; else `fit` warns. `fit` and `rated` return id, n_words, posterior
(rate, copies) only; `realised` returns the columns of `docs`. Column names that start with __vellum_ are reserved.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import written

PAIRS = 512


def pair_shares(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and damped shares of its hashed byte pairs."""
    w = K.words_of(texts)
    n = len(w.count)
    if not len(w.buf):
        return w.count, np.zeros((n, PAIRS), np.float32)
    pair = (w.buf[:-1].astype(np.int64) * 31 + w.buf[1:] * 17) % PAIRS
    doc = np.repeat(np.arange(n), np.diff(w.offs))
    c = np.bincount(doc[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    return w.count, np.sqrt(c / np.maximum(1, c.sum(axis=1, keepdims=True))).astype(np.float32)


#: How much a rate that differs from 1 weighs against the targets.
PULL = 1e-5


@dataclass(frozen=True)
class Mixer:
    """Domains with their classifier, and the steps that give each posterior its rate: row t of `steps` is what step t takes from a rate for
    each part of the posterior. Rates start at 1 less the posterior's part of `direction`."""

    domains: tuple[str, ...]
    weight: np.ndarray
    least_rate: float
    direction: np.ndarray
    steps: tuple[np.ndarray, ...] = ()
    missed: float = 0.0
    moved: float = 0.0
    settled: bool = True
    passes: int = 0

    def posterior(self, shares: np.ndarray) -> np.ndarray:
        z = shares @ self.weight[:-1] + self.weight[-1]
        z = np.exp((z - z.max(axis=1, keepdims=True)).astype(np.float64))
        return z / z.sum(axis=1, keepdims=True)

    def last_two(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates before and after the last step."""
        before = rate = np.maximum(self.least_rate, 1 - p @ self.direction)
        for step in self.steps:
            before, rate = rate, np.maximum(self.least_rate, rate - p @ step - PULL / (1 + PULL) * (rate - 1))
        return before, rate

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.last_two(p)[1]

    def sums(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """What these documents add to the words of each domain."""
        return (n * self.rates(p)) @ p

    def dual_sums(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """For rates at the start: what these documents add to the words of each domain, to the Hessian and to the dual objective."""
        z, most = p @ self.direction, 1 - self.least_rate
        cost = np.where(z <= most, z * z / 2 - z, -self.least_rate * z - most * most / 2)
        return np.concatenate([self.sums(n, p), ((p * (n * (z < most))[:, None]).T @ p).ravel(), [n @ cost]])

    def longest(self, p: np.ndarray) -> float:
        """How far the last step moved one of these rates at most."""
        before, rate = self.last_two(p)
        return float(np.abs(rate - before).max(initial=0.0))


def fit_classifier(x: np.ndarray, y: np.ndarray, domains: int, rounds: int = 400, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Softmax weights, the last row for the intercept, by accelerated gradient descent."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    goal = np.eye(domains)[y]
    w = ahead = np.zeros((x1.shape[1], domains))
    for t in range(rounds if len(x) else 0):
        z = x1 @ ahead
        z = np.exp(z - z.max(axis=1, keepdims=True))
        new = ahead - rate * (x1.T @ (z / z.sum(axis=1, keepdims=True) - goal) / len(x1) + ridge * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


KEY = "__vellum_key"


def _key(id_col: str):
    """A hash of the whole id, which fixes the rounding of its row."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias(KEY)


def _copies(rate: np.ndarray, key: pa.Array) -> np.ndarray:
    """Whole copies whose mean is the rate; the rounding is fixed by the key."""
    u = (K.mix(K.mix(key.to_numpy().view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(rate + u).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, domain: str = "lang", id_col: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, temper: float = 0.5, grow: bool = False, least_rate: float = 0.0, train_rows: int = 4000, rounds: int = 100, tolerance: float = 1e-4, still: float = 1e-4) -> tuple[Mixer, DataFrame, np.ndarray, np.ndarray]:
    """The fitted mixer, the written table (id, n_words, posterior), target and reached words of each domain.

    targets: words of each domain as shares of all words; by default the tempered natural shares, share**temper. grow=True
    scales the targets so that no domain's falls below its natural words."""
    ids = labels.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(train_rows)
    picked = docs.select(id_col, text, F.col(domain).cast("string").alias("__d")).where("__d is not null").join(F.broadcast(ids), id_col)
    picked = picked.groupBy(id_col).agg(F.min(F.struct("__d", F.col(text).alias("__t"))).alias("one")).select("one.__t", "one.__d")

    def sample(batches):
        for b in batches:
            for at, part in K.slices(K.column(b.column("__t")), 1 << 19, 512):
                yield pa.RecordBatch.from_arrays([b.column("__d").slice(at, len(part)), pa.array([x.tobytes() for x in pair_shares(part)[1]], pa.binary())], names=["d", "x"])

    got = picked.mapInArrow(K.tidy(sample), "d string, x binary").toPandas().sort_values(["d", "x"], kind="stable")
    domains = tuple(sorted(got["d"].unique())) or ("all",)
    if targets and (unknown := sorted(set(targets) - set(domains))):
        raise ValueError(f"no labelled document is of {unknown}")
    place = {d: i for i, d in enumerate(domains)}
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, PAIRS)
    weight = fit_classifier(x, got["d"].map(place).to_numpy(int), len(domains)).astype(np.float32)
    mixer, size = Mixer(domains, weight, least_rate, np.zeros(len(domains))), len(domains)

    def measure(batches):
        for b in batches:
            for at, part in K.slices(K.column(b.column(text)), 1 << 19, 512):
                n, s = pair_shares(part)
                yield pa.RecordBatch.from_arrays([b.column(id_col).slice(at, len(part)), pa.array(n.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(mixer.posterior(s).ravel()), size).cast(pa.list_(pa.float64()))], names=[id_col, "n_words", "posterior"])

    table = written(docs.select(id_col, text).mapInArrow(K.tidy(measure), T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])), "posteriors")

    def total(of, width: int, most=lambda p: 0.0) -> np.ndarray:
        """Sums over all documents of of(words, posteriors), an array a document, then the largest most(posteriors)."""

        def run(batches):
            s, top = np.zeros(width), 0.0
            for b in (b for b in batches if b.num_rows):
                p = b.column("posterior").flatten().to_numpy().reshape(-1, size)
                s += of(b.column("n_words").to_numpy().astype(float), p).reshape(-1)
                top = max(top, most(p))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array([*s, top])], names=["i", "s"])

        out = np.zeros(width + 1)
        for r in table.select("n_words", "posterior").mapInArrow(K.tidy(run), "i int, s double").groupBy("i").agg(F.sum("s").alias("s"), F.max("s").alias("top")).collect():
            out[r["i"]] = r["top"] if r["i"] == width else r["s"]
        return out

    gram = total(lambda n, p: (p * n[:, None]).T @ p, size * size)[:-1].reshape(size, size)
    natural = gram.sum(axis=1)
    words = max(1.0, natural.sum())
    share = natural / words
    aim = np.array([targets.get(d, 0.0) for d in domains]) if targets else share**temper
    aim = aim / max(aim.sum(), 1e-300) * words
    if grow:
        aim *= max(1.0, (natural / np.maximum(aim, 1e-300)).max())
    kept, reached, least, near, step, used = mixer, natural, np.inf, False, np.zeros(size), 0
    while not near and used < rounds:  # the start: Newton steps on the dual, halved until they descend
        used += 1
        sums = total(mixer.dual_sums, size + size * size + 1)[:-1]
        d = mixer.direction
        cost = sums[-1] + aim @ d + PULL * d @ gram @ d / 2
        if cost <= least - 1e-12 * abs(least) or used == 1:
            kept, reached, least = mixer, sums[:size], cost
            slope = aim - reached + PULL * gram @ d
            near = bool(np.abs(slope).max() <= tolerance * words)
            step = np.linalg.pinv(sums[size:-1].reshape(size, size) + PULL * gram, rcond=1e-12, hermitian=True) @ slope
        else:
            step = step / 2
            near = bool(np.abs(step).max() < 1e-9)
        mixer = replace(kept, direction=kept.direction - step)
    mixer, settled = kept, False
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) / (1 + PULL)
    while not settled and used < 2 * rounds:
        used += 1
        mixer = replace(mixer, steps=(*mixer.steps, inverse @ (reached - aim)))
        sums = total(mixer.sums, size, mixer.longest)
        reached, mixer = sums[:size], replace(mixer, moved=float(sums[-1]))
        settled = mixer.moved <= still
    mixer = replace(mixer, missed=float(np.abs(reached - aim).max() / words), settled=settled, passes=used)
    if not settled:
        warnings.warn(f"rates still move by {mixer.moved:.2g} after {rounds} passes, targets are missed by {mixer.missed:.2%} of all words", stacklevel=2)
    return mixer, table, aim, reached


def rated(table: DataFrame, mixer: Mixer, id_col: str = "doc_id") -> DataFrame:
    """The written table with rate and copies."""
    names = table.columns

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            rate = mixer.rates(b.column("posterior").flatten().to_numpy().reshape(-1, len(mixer.domains)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(rate), pa.array(_copies(rate, b.column(KEY)))], names=[*names, "rate", "copies"])

    return table.select("*", _key(id_col)).mapInArrow(K.tidy(run), T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.IntegerType())]))


def realised(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each row as often as its copies; the rates are replayed from the texts, without a join."""
    names = docs.columns

    def run(batches):
        for b in batches:
            for at, part in K.slices(K.column(b.column(text)), 1 << 19, 512):
                own = b.slice(at, len(part))
                copies = _copies(mixer.rates(mixer.posterior(pair_shares(part)[1])), own.column(KEY))
                yield own.select(names).take(pa.array(np.repeat(np.arange(len(part)), copies)))

    return docs.select("*", _key(id_col)).mapInArrow(K.tidy(run), docs.schema)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Languages mixed by the square roots of their natural shares, to as many words as there are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixer, table, _, _ = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated(table, mixer).select("doc_id", "n_words", "posterior", "rate", "copies")

"""Quality score by nearest-neighbour voting in a latent-semantic space.

A text is a vector of term counts: hashed words, and the shapes of words and of word pairs (first and last
character kinds, inner capitals, length, same word again). Counts are damped, weighted by inverse document
frequency of the labelled sample and projected on its leading singular vectors. The labelled vectors
(at most `most_labelled` of each label, the smallest ids by hash; `rank` numbers each) and the projection are
broadcast; their size is bounded by these parameters. Each document's cosine to all of them is exact, in
blocks; the `neighbours` nearest vote with weight max(cosine, 0)**`sharpness`, and label 1 counts by its true share.

One pass without a shuffle. Labels, language, source and id are no inputs of a score.

Cases: null and empty texts have no terms, their score is the share of label 1 in the sample; very long texts are counted
whole, one part of a batch each; labels other than 0 and 1 are ignored, without usable labels every score is 1; an id
repeated in the labels counts once (the lower label), in the documents once (the least text); of neighbours with the same cosine
those of smaller place in the sample, which is ordered by its terms, vote; repeated rows each come back; an empty table gives
an empty one. Extra columns are carried along unless they are called score or predicted, which the results replace. A
document that is itself in the sample is scored like any other, so judge accuracy on held-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import crc_bucket, one_text

WORDS, SHAPES, PAIRS = 256, 512, 256
DIM = WORDS + SHAPES + PAIRS

#: Kind of each byte: 0 lower, 1 upper, 2 digit, 3 stop, 4 quote or bracket, 5 symbol, 6 beyond ASCII, 7 other.
_KIND = np.full(256, 7, np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 6
_KIND[list(b".,;:!?")], _KIND[list(b"\"'()[]{}-")], _KIND[list(b"#*$%&|<>@^~=+_/\\")] = 3, 4, 5


def term_counts(texts: pa.Array) -> np.ndarray:
    """One row of DIM counts for each text of a part."""
    w = K.words_of(texts)
    n, doc, size = len(w.count), w.doc, w.end - w.start
    out = np.zeros((n, DIM), np.float32)
    if not len(doc):
        return out
    kind = _KIND[w.buf]
    upper = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(kind == 1, out=upper[1:])
    inner = (upper[w.end] - upper[w.start + 1]) > 0
    shape = ((kind[w.start] * 8 + kind[w.end - 1]) * 2 + inner) * 4 + np.minimum(3, (size - 1) // 4)
    same = w.again
    pair = np.zeros(len(doc), np.int64)
    pair[1:] = (kind[w.end[:-1] - 1] * 8 + kind[w.start[1:]]) * 2 + same[1:]
    for term, at in (((w.hash() >> np.uint64(20)).astype(np.int64) % WORDS, 0), (shape % SHAPES, WORDS), (pair + 128 * same, WORDS + SHAPES)):
        out += np.bincount(doc * DIM + at + term, minlength=n * DIM).reshape(n, DIM)
    return out


def _damped(c: np.ndarray) -> np.ndarray:
    """Shares of each kind of terms, damped: long and short texts are alike."""
    out = np.empty_like(c)
    for a, b, weight in ((0, WORDS, 0.4), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, DIM, 1.0)):
        part = c[:, a:b]
        out[:, a:b] = weight * np.sqrt(part / np.maximum(1, part.sum(axis=1, keepdims=True)))
    return out


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, of equal ones the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


@dataclass(frozen=True)
class Voters:
    projection: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    share: float
    neighbours: int
    sharpness: float

    def score(self, c: np.ndarray) -> np.ndarray:
        out = np.full(len(c), self.share)
        some = c.any(axis=1)
        if len(self.label) and some.any():
            z = _damped(c[some]) @ self.projection
            z /= np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True))
            cosine = z @ self.vectors.T
            k = min(self.neighbours, len(self.label))
            near = _nearest(cosine, k)
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** self.sharpness * self.weight[near]
            out[some] = (vote * self.label[near]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, label: np.ndarray, share: float, rank: int = 48, neighbours: int = 15, sharpness: float = 8.0) -> Voters:
    """Latent space and voters from the counts and labels (0 or 1) of a sample; share: of label 1 among all labels."""
    x = _damped(counts)
    idf = (1 + np.log((1 + len(x)) / (1 + (counts > 0).sum(axis=0)))).astype(np.float32)
    _, _, v = np.linalg.svd((x * idf).astype(np.float64), full_matrices=False) if len(x) else (0, 0, np.zeros((0, DIM)))
    projection = (idf[:, None] * v[:rank].T).astype(np.float32)
    z = x @ projection
    z /= np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True))
    own = label.mean() if len(label) else 1.0
    weight = np.where(label == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    return Voters(projection, z.astype(np.float32), label.astype(float), weight, share, neighbours, sharpness)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = 1500, held_out: int = 5, **how) -> Voters:
    """Voters from labelled rows whose crc32 of the id, modulo held_out, is not 0."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (crc_bucket(id_col, held_out) != 0)).groupBy(id_col).agg(F.min(label).cast("int").alias("__label"))
    total = {r["__label"]: r["count"] for r in ids.groupBy("__label").count().collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 1.0
    parts = [ids.where(F.col("__label") == x).orderBy(F.xxhash64(id_col), id_col).limit(most_labelled) for x in (0, 1)]
    picked = one_text(docs.select(id_col, text).join(F.broadcast(parts[0].unionByName(parts[1])), id_col), id_col, text)

    def run(batches):
        for b in batches:
            for at, part in K.slices(K.column(b.column(text)), 1 << 19, 512):
                c = term_counts(part)
                yield pa.RecordBatch.from_arrays([b.column("__label").slice(at, len(part)), pa.array([x.tobytes() for x in c], pa.binary())], names=["__label", "c"])

    got = picked.mapInArrow(K.tidy(run), "__label int, c binary").toPandas().sort_values(["c", "__label"], kind="stable")
    counts = np.frombuffer(b"".join(got["c"]), np.float32).reshape(-1, DIM)
    return fit(counts, got["__label"].to_numpy(), share, **how)


def classify(docs: DataFrame, voters: Voters, text: str = "text", threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """Rows of `docs` (without the text unless keep_text) with score (0 to 1) and predicted (score >= threshold)."""
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for b in batches:
            s = [shared.value.score(term_counts(part)) for _, part in K.slices(K.column(b.column(text)), 1 << 19, 512)]
            s = np.concatenate([np.zeros(0), *s])
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*[f.name for f in keep], "score", "predicted"])

    return docs.mapInArrow(K.tidy(run), T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    voters = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, voters).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

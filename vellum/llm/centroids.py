"""Exact clustering of whole-number vectors around centroids, with Hamerly's bounds.

Vectors are turned into whole numbers. A written table keeps each vector with its cluster, an upper bound of its distance to
its own centroid and a lower bound of that to the second-nearest one. A round is one pass over that table: the bounds
are loosened by how far centroids have moved, and a vector whose upper bound stays below its lower bound, or below half the
distance from its centroid to the next one, keeps its cluster unseen. Of the others the upper bound is made exact; those
that are still ambiguous get a full scan of exact integer distances (ties: the smaller number). Bounds are rounded outwards and
compared strictly, so a tie is never decided by a bound.

Centroid sums are whole numbers of any size, kept from round to round: a second pass reads only the vectors that changed their
cluster, subtracts them where they were and adds them where they are, pre-aggregated in each task. The driver holds `k` centroids and
gets two rows a cluster a round, and nothing else; `k` is a parameter, so the broadcast is bounded. No row is ever shuffled, so copies of a
vector and large clusters stay where they were read. The table of the round before is deleted when the next one is written.

Distances are exact at any size: in floats while they stay below 2**53, in 64-bit integers below 2**62, in unbounded integers
beyond; a distance that leaves the range of a long is set to its largest value, as are sums of distances.

Cases: null vectors, vectors of other lengths and vectors with null or non-finite components take no part; rows with a null id take part but
start no centroid unless all ids are null; repeated rows are rows of their own, also as first centroids, of equal ones all but the first
stay empty; fewer vectors than `k` give as many centroids; an empty table gives an empty result; a centroid that no vector is
nearest to stays where it is. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written
from .textkernel import lean

LONG_MAX = 2**63 - 1
#: The written table; `was` is the cluster before the last round, -1 for none.
_STATE = "vec_id long, kind int, v binary, cluster int, was int, upper double, lower double"
#: Sums travel in limbs of so many bits.
_LIMB = 60


def _exact(values: np.ndarray) -> np.ndarray:
    """floor() of finite doubles as 64-bit integers, or as unbounded integers where one is beyond 2**62."""
    whole = np.floor(values)
    if not len(whole) or np.abs(whole).max() < 2.0**62:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.ravel().tolist()], object).reshape(whole.shape)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v and c (whole numbers), as int64 or as unbounded integers."""
    most = max([1, *(int(np.abs(x).max()) for x in (v, c) if x.size)])
    if 4 * v.shape[1] * most * most < 2**53:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    kind = np.int64 if 4 * v.shape[1] * most * most < 2**62 else object
    a, b = v.astype(kind), c.astype(kind)
    return np.stack([((a - x) ** 2).sum(axis=1) for x in b], axis=1) if len(b) else np.zeros((len(a), 0), kind)


def _root(d2: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of whole numbers, rounded outwards by more than the error of the conversions."""
    if d2.dtype == object:
        r = np.array([float(min(math.isqrt(x) + up, 10**300)) if x < 10**600 or not up else np.inf for x in d2.tolist()])
    else:
        r = np.sqrt(d2.astype(np.float64))
    return np.nextafter(np.nextafter(r, np.inf), np.inf) if up else np.maximum(0.0, np.nextafter(np.nextafter(r, -np.inf), -np.inf))


def _between(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one, rounded down."""
    d2, half = squared(c, c), np.full(len(c), np.inf)
    for i in range(len(c) if len(c) > 1 else 0):
        half[i] = np.nextafter(_root(np.array([min(np.delete(d2[i], i).tolist())], object), False)[0] / 2, 0)
    return half


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, scanned) after the centroids have become c; moved: how far each moved, rounded up. A cluster of -1
    is unknown."""
    cluster, known = cluster.copy(), cluster >= 0
    upper, lower = upper.copy(), lower.copy()
    upper[known] = np.nextafter(upper[known] + moved[cluster[known]], np.inf)
    if len(c) > 1:
        first = int(np.argmax(moved))
        second = float(np.delete(moved, first).max())
        lower = np.maximum(0.0, np.nextafter(lower - np.where(cluster == first, second, moved[first]), -np.inf))
    bound = np.where(known, np.maximum(lower, _between(c)[np.maximum(cluster, 0)]), -np.inf)
    doubt = np.flatnonzero(~(upper < bound))
    own = doubt[known[doubt]]
    for j in np.unique(cluster[own]).tolist():  # the upper bound, made exact
        at = own[cluster[own] == j]
        upper[at] = _root(squared(v[at], c[j : j + 1])[:, 0], True)
    doubt = doubt[~(upper[doubt] < bound[doubt])]
    if len(doubt):
        d2 = squared(v[doubt], c)
        if d2.dtype == object:
            order = np.array([sorted(range(len(c)), key=lambda j, r=r: (r[j], j))[:2] for r in d2.tolist()])
        else:
            order = np.argsort(d2, axis=1, kind="stable")[:, :2]
        cluster[doubt] = order[:, 0]
        upper[doubt] = _root(np.take_along_axis(d2, order[:, :1], 1)[:, 0], True)
        lower[doubt] = _root(np.take_along_axis(d2, order[:, 1:2], 1)[:, 0], False) if len(c) > 1 else np.inf
    return cluster, upper, lower, len(doubt)


def _packed(row: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in the smallest form that holds them: 2, 4 or 8 bytes each, or (0) as text."""
    most = max(map(abs, row.tolist()), default=0)
    kind = next((k for k in (2, 4, 8) if most < 1 << (8 * k - 2)), 0)
    return kind, row.astype(f"<i{kind}").tobytes() if kind else ",".join(map(str, row.tolist())).encode()


def _unpacked(kinds: np.ndarray, packed: list[bytes], dim: int) -> np.ndarray:
    if len(packed) and kinds.min() == kinds.max() and kinds[0]:
        return np.frombuffer(b"".join(packed), f"<i{kinds[0]}").astype(np.int64).reshape(-1, dim)
    rows = [np.frombuffer(x, f"<i{k}").tolist() if k else [int(y) for y in x.split(b",")] for k, x in zip(kinds.tolist(), packed, strict=True)]
    return np.array(rows, object if not kinds.all() else np.int64).reshape(len(rows), dim)


def integers(vectors: DataFrame, dim: int, scale: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The written table's first rows: vectors of `dim` finite components, scaled and rounded down, without a cluster. A vector with
    a component whose multiple leaves the range of a double takes no part."""

    def run(batches):
        lean()
        for b in batches:
            col, ids, kinds, data = b.column(vector), [], [], []
            rows = [i for i, x in enumerate(col) if x.is_valid and len(x) == dim]
            flat = col.take(pa.array(rows, pa.int64())).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = flat * scale
            good = np.isfinite(x).all(axis=1)
            for i, row in zip(np.array(rows, np.int64)[good].tolist(), x[good], strict=True):
                kind, packed = _packed(_exact(row))
                ids.append(b.column(id_col)[i].as_py())
                kinds.append(kind)
                data.append(packed)
            n = len(ids)
            none = np.full(n, -1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary()), pa.array(none), pa.array(none), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n))], names=["vec_id", "kind", "v", "cluster", "was", "upper", "lower"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vector).mapInArrow(run, _STATE)


def _round(state: DataFrame, c: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The table after one assignment to the centroids c."""
    told = state.sparkSession.sparkContext.broadcast((c, moved))

    def run(batches):
        lean()
        c, moved = told.value
        for b in batches:
            v = _unpacked(b.column("kind").to_numpy(), b.column("v").to_pylist(), c.shape[1])
            was = b.column("cluster").to_numpy()
            cluster, upper, lower, _ = reassign(v, was, b.column("upper").to_numpy(), b.column("lower").to_numpy(), c, moved)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("vec_id", "kind", "v")), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "kind", "v", "cluster", "was", "upper", "lower"])

    return state.mapInArrow(run, _STATE)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]]]:
    """By how much the counts and sums of the k clusters change through the vectors that changed their cluster."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            v = _unpacked(b.column("kind").to_numpy(), b.column("v").to_pylist(), dim)
            v = np.concatenate([np.ones((len(v), 1), v.dtype), v], axis=1)
            v = v if len(v) == 0 or max(int(np.abs(v).max()), 1) * len(v) < 2**62 else v.astype(object)
            for sign, own in ((1, b.column("cluster").to_numpy()), (-1, b.column("was").to_numpy())):
                for j in np.unique(own[own >= 0]).tolist():
                    for i, x in enumerate(v[own == j].sum(axis=0).tolist()):
                        total[j, i] = total.get((j, i), 0) + sign * int(x)
        rows = []
        for (j, i), x in total.items():
            limb = 0
            while x:
                low = x if abs(x) < 1 << _LIMB else x & (1 << _LIMB) - 1
                rows.append((j, i, limb, low))
                x, limb = (x - low) >> _LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([*(pa.array([r[n] for r in rows], pa.int32()) for n in range(3)), pa.array([Decimal(r[3]) for r in rows], pa.decimal128(38, 0))], names=["j", "i", "limb", "x"])

    parts = state.where("cluster <> was").select("kind", "v", "cluster", "was").mapInArrow(run, "j int, i int, limb int, x decimal(38,0)")
    out = [[0] * (dim + 1) for _ in range(k)]
    for r in parts.groupBy("j", "i", "limb").agg(F.sum("x").alias("x")).collect():  # at most k * (dim + 1) numbers, a row for each 60 bits
        out[r["j"]][r["i"]] += int(r["x"]) << _LIMB * r["limb"]
    return [x[0] for x in out], [x[1:] for x in out]


def _whole(rows: list[list[int]], dim: int) -> np.ndarray:
    fits = all(abs(x) < 2**62 for row in rows for x in row)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), dim)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256). First centroids: the k vectors whose SHA-256 of
    `seed:id` is smallest, of equal ids the smaller vector. A round that moves no centroid is the last that needs a pass."""
    state = written(integers(vectors, dim, scale, id_col, vector), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = state.orderBy(digest.asc_nulls_last(), "kind", "v").limit(k).select("kind", "v").collect()
    c = _whole([_unpacked(np.array([r["kind"]]), [bytes(r["v"])], dim)[0].tolist() for r in first], dim)
    k = len(c)
    if not k:
        return state.select("vec_id", "cluster", *(F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    moved = np.zeros(k)
    for _ in range(rounds):
        before, state = state, written(_round(state, c, moved), "bounds")
        drop(before)
        n, x = _changes(state, k, dim)
        counts = [a + b for a, b in zip(counts, n, strict=True)]
        sums = [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(sums, x, strict=True)]
        new = _whole([[s // m for s in own] if m else old for own, m, old in zip(sums, counts, c.tolist(), strict=True)], dim)
        moved = np.array([_root(squared(new[j : j + 1], c[j : j + 1])[:, 0], True)[0] if (new[j] != c[j]).any() else 0.0 for j in range(k)])
        c = new
        if not moved.any():
            break
    told = state.sparkSession.sparkContext.broadcast(c)

    def measure(batches):
        for b in batches:
            v, own = _unpacked(b.column("kind").to_numpy(), b.column("v").to_pylist(), dim), b.column("cluster").to_numpy()
            d = np.zeros(len(v), np.int64)
            for j in np.unique(own).tolist():
                d[own == j] = [min(x, LONG_MAX) for x in squared(v[own == j], told.value[j : j + 1])[:, 0].tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])

    last = written(_round(state, c, moved).mapInArrow(measure, "vec_id long, cluster int, distance long"), "assigned", lasting=True)
    drop(state)
    own = {r["cluster"]: int(r["d"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    bounded = lambda x: F.lit(min(x, LONG_MAX)).cast("long")
    named = F.array(*(F.struct(bounded(own.get(j, 0)).alias("d"), F.lit(hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()).alias("sha")) for j in range(k)))
    told_ = F.get(named, F.col("cluster"))
    return last.select("vec_id", "cluster", "distance", told_["d"].alias("cluster_inertia"), bounded(sum(own.values())).alias("inertia"), told_["sha"].alias("centroid_sha256"))


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

"""Approximate nearest neighbours by balanced posting lists; nearness is the largest inner product.

Index. Inner products become distances by one more component: with M the longest norm, a vector x/M gets sqrt(1 - |x/M|**2), a query
q/|q| gets 0, and a larger product is a smaller distance. Centroids are fitted on a bounded sample (`sample_rows`, the smallest by a hash of
their place) by k-means with a penalty a list that grows while the list is too full: lists are balanced. Every vector is indexed: it goes to
its nearest list and, near a boundary, to up to `replicas` - 1 more whose centroid is within `boundary` times that distance and not
nearer to a list already taken than to the vector. Neighbouring lists fill groups of about `group_rows` rows; a list that is longer, as many
copies of one vector make it, is cut into several groups by a hash of the rows' places, so every group is bounded and no row is left out.

Search. The centroids form a neighbour graph that every task holds in memory (at most `most_lists` of them, whatever the size of the table). A
query walks it from its entry points along links, always through the nearest unvisited centroid within `ratio` times the distance to
the nearest one found; the lists within that ratio are read, all of them. `ratio` is calibrated on the sample: the least at which `target`
of the exact neighbours of sampled queries lie in a list within it. Groups stay where they are and queries travel to them: a task
holds one group at a time and streams the queries that asked for a list in it, so no task grows with the queries, and a query crosses the
network once a group. Queries carry a lower bound of their k-th score, from the `seeds` sampled vectors that their lists hold, so a group answers
only what can still matter, k rows a query at most; a vector that is met in two lists counts once. A query that finds fewer than k, as where its
lists hold little but rows of its own id, is asked again of all lists.

Scores are products of the original components in double precision, added in one fixed order: equal vectors have equal scores, and a
matrix product in another order only proposes, with slack. A product that overflows is infinite, one without a value counts as -inf.

Cases: null and zero vectors and vectors with null or non-finite components take no part; rows with a null id take no part; vectors of other
lengths (dimensions) only meet among themselves, those of the 16 most frequent lengths have lists, others one list each; repeated ids are rows
of their own, a query skips all rows of its id; ties go to the smaller id; with fewer candidates than k all are given; a small table is one list and
thus exact; an empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .textkernel import lean, mix


def _norms(a: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow on the way."""
    most = np.abs(a).max(axis=1, initial=0.0)
    most = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((a / most[:, None]) ** 2).sum(axis=1))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of c, pair by pair, added in one order."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (q * c).sum(axis=1)
    return np.where(np.isnan(s), -np.inf, s)


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest norm, with the component that makes all of them unit vectors."""
    x = v / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)


def directed(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, with 0 as their last component."""
    return np.concatenate([q / _norms(q)[:, None], np.zeros((len(q), 1))], axis=1)


def _distances(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, pull: float = 0.5) -> np.ndarray:
    """Spherical k-means in which a list's penalty rises while it holds more than its share."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    penalty, share = np.zeros(lists), len(x) / lists
    for _ in range(rounds):
        d2 = _distances(x, c) ** 2
        own = np.argmin(d2 + penalty, axis=1)
        count = np.bincount(own, minlength=lists)
        penalty += pull * d2.min(axis=1).mean() * np.clip(count / share - 1, -1, 1) / 4
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = _norms(sums)
        c = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1.0)[:, None], c)
    return c


@dataclass
class Index:
    """Centroids of one dimension, their graph, and what selects lists. `base` is the number of its first list."""

    base: int
    longest: float
    centroids: np.ndarray
    links: np.ndarray
    ratio: float
    boundary: float
    replicas: int

    @property
    def lists(self) -> int:
        return max(1, len(self.centroids))

    def place(self, v: np.ndarray) -> list[list[int]]:
        """The lists of each vector, nearest first."""
        if len(self.centroids) < 2:
            return [[0]] * len(v)
        d = _distances(lifted(v, self.longest), self.centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, : 4 * self.replicas]
        out = []
        for row, order in zip(d, near.tolist(), strict=True):
            taken = [order[0]]
            for j in order[1:]:
                if len(taken) == self.replicas or row[j] > self.boundary * row[order[0]]:
                    break
                if all(self.between[j, i] >= row[j] for i in taken):
                    taken.append(j)
            out.append(taken)
        return out

    @property
    def between(self) -> np.ndarray:
        if not hasattr(self, "_between"):
            self._between = _distances(self.centroids, self.centroids)
        return self._between

    def select(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of all lists that the walks through the graph find within the ratio."""
        n, m = len(q), len(self.centroids)
        if m < 2:
            return np.arange(n), np.zeros(n, np.int64)
        a, norm = directed(q), (self.centroids**2).sum(axis=1)
        dist = np.full((n, m), np.inf)
        closed = np.zeros((n, m), bool)

        def see(rows: np.ndarray, at: np.ndarray) -> None:
            """Distances from each query to the centroids in its row of `at`."""
            c = self.centroids[at]
            d2 = 1 - 2 * np.einsum("ijk,ik->ij", c, a[rows]) + norm[at]
            dist[rows[:, None], at] = np.sqrt(np.maximum(0.0, d2))

        entries = np.linspace(0, m - 1, min(m, 8)).astype(int)
        see(np.arange(n), np.broadcast_to(entries, (n, len(entries))))
        live = np.arange(n)
        while len(live):
            open_ = np.where(closed[live], np.inf, dist[live])
            step = np.argmin(open_, axis=1)
            reach = self.ratio * dist[live].min(axis=1)
            on = open_[np.arange(len(live)), step] <= reach
            live, step = live[on], step[on]
            closed[live, step] = True
            if len(live):
                see(live, self.links[step])
        return np.nonzero(dist <= self.ratio * dist.min(axis=1, keepdims=True))


def _graph(c: np.ndarray, degree: int) -> np.ndarray:
    """Links of each centroid: its nearest others, and the next one in the order of numbers, so that all are reached."""
    d = _distances(c, c)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : max(1, min(degree, len(c) - 1))]
    return np.concatenate([near, ((np.arange(len(c)) + 1) % len(c))[:, None]], axis=1)


def fit(base: int, sample: np.ndarray, longest: float, lists: int, k: int, target: float, boundary: float, replicas: int, degree: int = 24, asked: int = 256) -> Index:
    """An index of one dimension from sampled vectors; `longest`: the longest norm of all vectors."""
    none = Index(base, longest, np.zeros((0, sample.shape[1] + 1)), np.zeros((0, 1), np.int64), 1.0, boundary, replicas)
    if lists < 2 or len(sample) < 2 * lists:
        return none
    x = lifted(sample, longest)
    c = balanced_centroids(x, lists)
    out = Index(base, longest, c, _graph(c, degree), np.inf, boundary, replicas)
    # how far, in multiples of the distance to the nearest centroid, the best list of each exact neighbour is
    rows = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
    product = sample[rows] @ sample.T
    product[np.arange(len(rows)), rows] = -np.inf
    near = np.argsort(-product, axis=1, kind="stable")[:, :k]
    d = _distances(directed(sample[rows]), c)
    d /= np.maximum(d.min(axis=1, keepdims=True), 1e-12)
    at = out.place(sample)
    need = np.array([min(d[i, j] for j in at[x]) for i, own in enumerate(near.tolist()) for x in own])
    out.ratio = float(np.quantile(need, target)) * (1 + 1e-9)
    return out


_ROWS = "g int, kind int, pos long, id long, lists array<int>, dim int, v binary, bound double"


def usable(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, str]:
    """(id, v packed, dim, norm) of the vectors that take part, and the packed type."""
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches):
        lean()
        for b in batches:
            col = b.column(vector)
            size = np.array([len(x) if x.is_valid else 0 for x in col], np.int64)
            flat, at = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.cumsum(size) - size
            good = np.isfinite(flat)
            keep = [i for i in np.flatnonzero((size > 0) & b.column(id_col).is_valid().to_numpy(zero_copy_only=False)).tolist() if good[at[i] : at[i] + size[i]].all() and flat[at[i] : at[i] + size[i]].any()]
            rows = [flat[at[i] : at[i] + size[i]] for i in keep]
            norms = [float(_norms(x[None])[0]) for x in rows]
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(keep, pa.int64())), pa.array([x.astype(kind).tobytes() for x in rows], pa.binary()), pa.array(size[keep].astype(np.int32)), pa.array(norms, pa.float64())], names=["id", "v", "dim", "norm"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vector).mapInArrow(run, "id long, v binary, dim int, norm double"), kind


def _of(packed: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind).astype(np.float64).reshape(len(packed), dim)


def _by_dim(b: pa.RecordBatch, most: int = 1024) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for at in range(0, len(rows), most):
            yield dim, b.take(pa.array(rows[at : at + most]))


def _hash(pos: np.ndarray) -> np.ndarray:
    return mix(pos.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)


class _Group:
    """The vectors of one group, by list."""

    def __init__(self, parts: list[pa.RecordBatch], kind: str):
        t = pa.Table.from_batches(parts)
        own = t.column("lists").combine_chunks().flatten().to_numpy()
        self.blocks = {}
        for at in np.unique(own).tolist():
            rows = t.take(pa.array(np.flatnonzero(own == at)))
            v = _of(rows.column("v").combine_chunks(), kind, rows.column("dim")[0].as_py())
            self.blocks[at] = (rows.column("pos").to_numpy(), rows.column("id").to_numpy(), v, float(_norms(v).max()))

    def answer(self, q_pos: np.ndarray, q_id: np.ndarray, q: np.ndarray, bound: np.ndarray, wanted: list[list[int]], k: int, cells: int = 1 << 22) -> list[np.ndarray]:
        """(q_pos, q_id, pos, id, score) of the k nearest of each query in the lists that it wants and above its bound."""
        size, found = _norms(q), []
        bound = bound.copy()
        asks: dict[int, list[int]] = {}
        for i, lists in enumerate(wanted):
            for at in lists:
                asks.setdefault(at, []).append(i)
        for at in sorted(asks.keys() & self.blocks.keys()):
            pos, ids, v, longest = self.blocks[at]
            for rows in np.array_split(np.array(asks[at]), -(-len(asks[at]) * len(v) // cells)):
                with np.errstate(over="ignore", invalid="ignore"):
                    s = q[rows] @ v.T
                    slack = 1e-12 * size[rows] * longest
                    s[q_id[rows][:, None] == ids[None]] = -np.inf
                    take = ~(s < (bound[rows] - slack)[:, None]) & (q_id[rows][:, None] != ids[None])
                    many = np.flatnonzero(take.sum(axis=1) > k)
                    if len(many):
                        low = np.nan_to_num(np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack[many], nan=-np.inf)
                        bound[rows[many]] = np.maximum(bound[rows[many]], low)
                        take[many] &= ~(s[many] < low[:, None])
                i, j = np.nonzero(take)
                found.append((rows[i], pos[j], ids[j], scores(q[rows[i]], v[j])))
        if not found:
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        i, pos, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pos, ids, -s, i))
        i, pos, ids, s = i[order], pos[order], ids[order], s[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (pos[1:] != pos[:-1])  # the same vector from another list stands beside it
        i, pos, ids, s = i[new], pos[new], ids[new], s[new]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, pos, ids, s = i[keep], pos[keep], ids[keep], s[keep]
        return [q_pos[i], q_id[i], pos, ids, s]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", list_rows: int = 512, most_lists: int = 1024, sample_rows: int = 16384, seeds: int = 8192, target: float = 0.95, boundary: float = 1.05, replicas: int = 3, group_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query (over column `id`) holds."""
    spark = vectors.sparkSession
    made, kind = usable(vectors, id_col, vector)
    rows = written(made.withColumn("pos", F.monotonically_increasing_id()), "vectors")
    dims = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}  # a row a length
    common = sorted(dims, key=lambda d: (-dims[d]["n"], d))[:16]
    index, seed, base = {}, {}, 0
    for dim in sorted(dims):
        sample_id, sample = np.zeros(0, np.int64), np.zeros((0, dim))
        if dim in common:
            got = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("pos"), "pos").limit(sample_rows).select("id", "v").collect()
            sample_id, sample = np.array([r["id"] for r in got], np.int64), np.frombuffer(b"".join(bytes(r["v"]) for r in got), kind).astype(np.float64).reshape(-1, dim)
        index[dim] = fit(base, sample, dims[dim]["longest"], min(most_lists, dims[dim]["n"] // list_rows), k, target, boundary, replicas)
        lists = index[dim].place(sample[:seeds])
        seed[dim] = (sample_id[:seeds], sample[:seeds], np.array([[*x, *[index[dim].lists] * (replicas - len(x))] for x in lists], np.int64).reshape(-1, replicas))
        base += index[dim].lists
    told, seeded = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(seed)

    def place(batches):
        lean()
        for batch in batches:
            for dim, b in _by_dim(batch):
                at = told.value[dim]
                lists = at.place(_of(b.column("v"), kind, dim))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("pos", "id", "v", "dim")), pa.array([[at.base + x for x in y] for y in lists], pa.list_(pa.int32()))], names=["pos", "id", "v", "dim", "lists"])

    placed = written(rows.mapInArrow(place, "pos long, id long, v binary, dim int, lists array<int>"), "placed")
    held = {r["l"]: r["count"] for r in placed.select(F.explode("lists").alias("l")).groupBy("l").count().collect()}  # a row a list
    most = group_rows or max(1024, min(131072, sum(held.values()) // 24))
    first, cuts, group, full = np.zeros(base, np.int64), np.ones(base, np.int64), 0, 0
    for at in range(base):
        n = held.get(at, 0)
        cuts[at] = max(1, -(-n // most))
        if full and full + n > most:
            group, full = group + 1, 0
        first[at] = group
        group, full = (group + int(cuts[at]), 0) if cuts[at] > 1 else (group, full + n)
    dealt = spark.sparkContext.broadcast((first, cuts))

    def send(batches):
        first, cuts = dealt.value
        for b in batches:
            n = np.array([len(x) for x in b.column("lists")])
            own, rows_ = b.column("lists").flatten().to_numpy(), np.repeat(np.arange(b.num_rows), n)
            g = first[own] + (_hash(b.column("pos").to_numpy())[rows_] % cuts[own].astype(np.uint64)).astype(np.int64)
            c = b.take(pa.array(rows_))
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(np.zeros(len(g), np.int32)), c.column("pos"), c.column("id"), pa.array([[x] for x in own.tolist()], pa.list_(pa.int32())), c.column("dim"), c.column("v"), pa.array(np.full(len(g), -np.inf))], names=["g", "kind", "pos", "id", "lists", "dim", "v", "bound"])

    def asks(everywhere: bool):
        def ask(batches):
            lean()
            first, cuts = dealt.value
            for batch in batches:
                for dim, b in _by_dim(batch):
                    q, ids, at = _of(b.column("v"), kind, dim), b.column("id").to_numpy(), told.value[dim]
                    seed_id, seed_v, seed_lists = seeded.value[dim]
                    i, own = np.nonzero(np.ones((len(q), at.lists), bool)) if everywhere else at.select(q)
                    read = np.zeros((len(q), at.lists + 1), bool)  # the last column: no list
                    read[i, own] = True
                    bound = np.full(len(q), -np.inf)
                    if len(seed_id) > k:
                        with np.errstate(over="ignore", invalid="ignore"):
                            s = np.nan_to_num(q @ seed_v.T, nan=-np.inf)
                        met = np.logical_or.reduce([read[:, x] for x in seed_lists.T])
                        s[~met | (ids[:, None] == seed_id[None])] = -np.inf
                        bound = np.partition(s, len(seed_id) - k, axis=1)[:, len(seed_id) - k] - 1e-12 * _norms(q) * at.longest
                    wants: dict[tuple[int, int], list[int]] = {}
                    for x, y in zip(i.tolist(), (at.base + own).tolist(), strict=True):
                        for g in range(first[y], first[y] + cuts[y]):
                            wants.setdefault((x, g), []).append(y)
                    c = b.take(pa.array([x for x, _ in wants], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([g for _, g in wants], pa.int32()), pa.array(np.ones(len(wants), np.int32)), c.column("pos"), c.column("id"), pa.array(list(wants.values()), pa.list_(pa.int32())), c.column("dim"), c.column("v"), pa.array(bound[[x for x, _ in wants]])], names=["g", "kind", "pos", "id", "lists", "dim", "v", "bound"])

        return ask

    def search(batches):
        lean()
        at, parts, group = -1, [], None
        for b in batches:
            key = b.column("g").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            cut = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            for begin, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                run, g, asked = b.slice(begin, end - begin), int(key[begin]) // 2, int(key[begin]) % 2
                if g != at:
                    at, parts, group = g, [], None
                if not asked:
                    parts.append(run)
                    continue
                if group is None and parts:
                    group, parts = _Group(parts, kind), []
                for dim, own in _by_dim(run) if group else ():
                    out = group.answer(own.column("pos").to_numpy(), own.column("id").to_numpy(), _of(own.column("v"), kind, dim), own.column("bound").to_numpy(), own.column("lists").to_pylist(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["q_pos", "query_id", "pos", "vec_id", "score"])

    def answered(queries: DataFrame, everywhere: bool = False) -> DataFrame:
        met = placed.mapInArrow(send, _ROWS).unionByName(queries.mapInArrow(asks(everywhere), _ROWS)).repartition("g").sortWithinPartitions("g", "kind")
        found = met.mapInArrow(search, "q_pos long, query_id long, pos long, vec_id long, score double")
        # a vector found in two lists has one place, so it takes one rank
        rank = F.dense_rank().over(W.partitionBy("q_pos").orderBy(F.desc("score"), "vec_id", "pos"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["q_pos", "rank"]).select("q_pos", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    queries = placed.where(is_query)
    found = written(answered(queries), "found", lasting=True)
    full = found.where(F.col("rank") == k).select(F.col("q_pos").alias("pos"))
    short = written(queries.join(full, "pos", "left_anti").select(placed.columns), "short")
    if not short.isEmpty():
        found = found.join(full.withColumnRenamed("pos", "q_pos"), "q_pos", "left_semi").unionByName(answered(short, everywhere=True))
    return found.drop("q_pos")


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("id") % 20 == 0)

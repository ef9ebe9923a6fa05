"""Exact top-k inner products by norm buckets.

Vectors are turned into whole numbers, and every product is exact at any size: in floats while all sums stay below 2**53, in
64-bit integers below 2**63, in unbounded integers beyond; a score that leaves the range of a long is set to its nearest bound. Candidates are grouped by length: bucket b
holds norms of ratio**b to ratio**(b+1), cut into blocks of about `block_rows` by a hash, so any number of equal vectors or
lengths spreads. Queries travel in blocks too. A query's running bound t (its k-th best product so far; first
from the longest `seeds` vectors, which are candidates like all others) turns into a local cosine threshold
c = t / (|q| * longest norm of the block):
  c > 1: no candidate of the block can enter, it is skipped (the longest block is known before the data meet);
  c < coordinate_from: length pruning, only candidates of norm >= t / |q| are multiplied;
  else: coordinate pruning: the unit coordinate of a candidate of cosine >= c lies within
  q_f * c +- sqrt((1 - c*c) * (1 - q_f*q_f)) (up to 1 where q_f > c, down to -1 where q_f < -c) for each of q's largest
  coordinates f; those that pass are multiplied.
Bounds have slack for rounding; equal products are never pruned, so ties go to the smaller id.

All query blocks meet all candidate blocks that their bounds allow: that is a stated query set against all
rows, in blocks. A task holds one query block and one group of candidate blocks. A query block grows with the queries from 512
to 8,192 rows and a group from 4 to 64 blocks, so a candidate travels once for each 8,192 queries that its block can
reach; bounds of query blocks are broadcast, 16 bytes each. Partial results have at most k rows for each query and group of
candidate blocks. Rows are dealt by their place in a written table, so copies of a row spread like others.

Cases: null vectors and vectors with null or non-finite components take no part; components beyond 1e300 count as 1e300; very
long vectors are rows like others; vectors of other lengths
(dimensions) are only compared among themselves; zero vectors have product 0 with all; rows with a null id take no part; a
repeated id is a row of its own, also as a query, whose copies are ranked each for itself; a query skips all rows of its id; fewer candidates than k give all; an empty
table gives an empty result. Other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .textkernel import mix


def integers(vectors: DataFrame, scale: float, id_col: str, vector: str) -> DataFrame:
    """(id, v packed 64-bit floats of whole numbers, dim, norm) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            ids, vecs, dims, norms = [], [], [], []
            col = batch.column(vector)
            flat, offs = col.flatten(), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in col)])
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            good = np.isfinite(values)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * np.where(good, values, 0.0)), -1e300, 1e300)
            for i, (key, x) in enumerate(zip(batch.column(id_col), col, strict=True)):
                a, b = offs[i], offs[i + 1]
                if x.is_valid and key.is_valid and good[a:b].all():
                    ids.append(key.as_py())
                    vecs.append(whole[a:b].tobytes())
                    dims.append(b - a)
                    norms.append(float(_norms(whole[None, a:b])[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], names=["id", "v", "dim", "norm"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vector).mapInArrow(run, "id long, v binary, dim int, norm double")


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)


def _norms(a: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow on the way."""
    most = np.maximum(1.0, np.abs(a).max(axis=1, initial=0.0))
    return most * np.sqrt(((a / most[:, None]) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers, as longs; those beyond the range of a long are its bounds."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[-1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    exact = whole(a) @ whole(b).T if a.shape[-1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _small(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(x).max() if x.size else 0
    kind = next((k for k, top in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if most <= top), "f8")
    return kind, x.astype(kind).tobytes()


def _kth(scores: np.ndarray, k: int) -> float:
    """A float that is not above the k-th largest of some longs."""
    return float(np.nextafter(float(np.partition(scores, len(scores) - k)[len(scores) - k]), -np.inf)) if len(scores) >= k else -np.inf


def _search_block(q: np.ndarray, q_id: np.ndarray, bound: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, coordinate_from: float, focus: int, best: list) -> None:
    """Adds to best[i] (scores, ids) what block c has for query i, and raises bound[i]."""
    norm = _norms(c)
    order = np.argsort(-norm, kind="stable")
    c, c_id, norm = c[order], c_id[order], norm[order]
    unit = c / np.maximum(norm, 1e-300)[:, None]
    size = _norms(q)
    for i in range(len(q)):
        t, rows = bound[i], slice(None)
        if t > 0 and size[i] > 0:
            local = t / (size[i] * max(norm[0], 1e-300)) * (1 - 1e-9)
            if local > 1:
                continue
            reach = int(np.searchsorted(-norm, -(t / size[i]) * (1 - 1e-9), "right"))
            if local < coordinate_from:
                rows = slice(0, reach)
            else:
                u = q[i] / size[i]
                fs = np.argpartition(-np.abs(u), min(focus, len(u)) - 1)[:focus]
                wide = np.sqrt(max(0.0, 1 - local * local) * (1 - np.minimum(1, u[fs] ** 2)))
                low = np.where(u[fs] < -local, -1.0, u[fs] * local - wide) - 1e-9
                high = np.where(u[fs] > local, 1.0, u[fs] * local + wide) + 1e-9
                near = unit[:reach, fs]
                rows = np.flatnonzero(((near >= low) & (near <= high)).all(axis=1))
        s, own = _products(q[i : i + 1], c[rows])[0], c_id[rows]
        take = (s >= t) & (own != q_id[i])
        if take.any():
            best[i] = (np.concatenate([best[i][0], s[take]]), np.concatenate([best[i][1], own[take]]))
            if len(best[i][0]) > k:
                top = np.lexsort((best[i][1], -best[i][0]))[:k]
                best[i] = (best[i][0][top], best[i][1][top])
            bound[i] = max(bound[i], _kth(best[i][0], k))


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding", ratio: float = 1.1, block_rows: int = 4096, query_rows: int | None = None, seeds: int = 512, coordinate_from: float = 0.6, focus: int = 4, group_blocks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each row for which is_query (over column `id`) holds."""
    spark = vectors.sparkSession
    rows = written(integers(vectors, scale, id_col, vector).withColumn("pos", F.monotonically_increasing_id()), "vectors")
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(ratio)))).otherwise(-1).cast("int")
    rows = rows.withColumn("bucket", bucket)
    # small: a row for each power of `ratio` that a norm can be, for each dimension
    sizes = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(is_query, 1).otherwise(0)).alias("nq")).collect()
    cut = {(r["dim"], r["bucket"]): max(1, -(-r["n"] // block_rows)) for r in sizes}
    groups: dict[int, int] = {}
    parts: dict[int, int] = {}
    for r in sizes:
        groups[r["dim"]] = groups.get(r["dim"], 0) + cut[r["dim"], r["bucket"]]
        parts[r["dim"]] = parts.get(r["dim"], 0) + r["nq"]
    groups = {d: max(1, -(-n // (group_blocks or min(64, max(4, n // 64))))) for d, n in groups.items()}
    parts = {d: max(1, -(-n // (query_rows or min(8192, max(512, n // 64))))) for d, n in parts.items()}
    told = spark.sparkContext.broadcast((cut, groups, parts))
    common = sorted(parts, key=lambda d: -parts[d])[:16]  # other dimensions start without bounds
    first = {d: rows.where(F.col("dim") == d).orderBy(F.desc("norm"), "id").limit(seeds).select("id", "v").collect() for d in common}
    seed = spark.sparkContext.broadcast({d: (np.array([r["id"] for r in x], np.int64), _matrix([bytes(r["v"]) for r in x], d)) for d, x in first.items()})

    def place(batches):
        cut, groups, parts = told.value
        for b in batches:
            h = _hash(b.column("pos").to_numpy())
            dims, own = b.column("dim").to_pylist(), b.column("bucket").to_pylist()
            block = (h % np.array([cut[x] for x in zip(dims, own, strict=True)], np.uint64)).astype(np.int32)
            g = [(7919 * w + x) % groups[d] for d, w, x in zip(dims, own, block.tolist(), strict=True)]
            qb = (h % np.array([parts[d] for d in dims], np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(g, pa.int32()), pa.array(qb)], names=[*b.schema.names, "block", "g", "qb"])

    def pack(t: pa.Table) -> pa.Table:
        kind, data = _small(_matrix(t.column("v").to_pylist(), t.column("dim")[0].as_py()))
        return pa.table({"dim": t.column("dim").slice(0, 1), "g": t.column("g").slice(0, 1), "top": pa.array([float(t.column("norm").to_numpy().max())]), "ids": pa.array([t.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "kind": pa.array([kind]), "data": pa.array([data], pa.binary())})

    def ready(t: pa.Table) -> pa.Table:
        """A query block with first bounds from the seeds, and the least norm of a candidate that can matter."""
        dim = t.column("dim")[0].as_py()
        ids, q = t.column("id").to_numpy().astype(np.int64), _matrix(t.column("v").to_pylist(), dim)
        bound = np.full(len(q), -np.inf)
        if dim in seed.value:
            seed_id, seed_v = seed.value[dim]
            bound = np.array([_kth(row[seed_id != i], k) for i, row in zip(ids.tolist(), _products(q, seed_v), strict=True)])
        size = _norms(q)
        least = np.where((bound > 0) & (size > 0), bound / np.maximum(size, 1e-300), 0.0).min() * (1 - 1e-9)
        kind, data = _small(q)
        return pa.table({"dim": t.column("dim").slice(0, 1), "qb": t.column("qb").slice(0, 1), "least": pa.array([float(least)]), "ids": pa.array([ids.tobytes()], pa.binary()), "places": pa.array([t.column("pos").to_numpy().astype(np.int64).tobytes()], pa.binary()), "kind": pa.array([kind]), "data": pa.array([data], pa.binary()), "bounds": pa.array([bound.tobytes()], pa.binary())})

    placed = rows.mapInArrow(place, "id long, v binary, dim int, norm double, pos long, bucket int, block int, g int, qb int")
    blocks = placed.groupBy("dim", "bucket", "block").applyInArrow(pack, "dim int, g int, top double, ids binary, kind string, data binary")
    queries = written(placed.where(is_query).groupBy("dim", "qb").applyInArrow(ready, "dim int, qb int, least double, ids binary, places binary, kind string, data binary, bounds binary"), "queries")
    asked: dict[int, list[tuple[int, float]]] = {}
    for r in queries.select("dim", "qb", "least").collect():
        asked.setdefault(r["dim"], []).append((r["qb"], r["least"]))
    asked_ = spark.sparkContext.broadcast({d: (np.array([x for x, _ in v], np.int32), np.array([x for _, x in v])) for d, v in asked.items()})

    def send(batches):
        """Each candidate block to the query blocks whose bounds it can reach."""
        for b in batches:
            for i in range(b.num_rows):
                qb, least = asked_.value.get(b.column("dim")[i].as_py(), (np.zeros(0, np.int32), np.zeros(0)))
                for x in qb[least <= b.column("top")[i].as_py()].tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), *(c.slice(i, 1) for c in b.columns)], names=["qb", *b.schema.names])

    def meet(batches):
        for b in batches:
            n = [told.value[1][d] for d in b.column("dim").to_pylist()]
            rows_ = np.repeat(np.arange(b.num_rows), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32) if n else np.zeros(0, np.int32)), *(c.take(pa.array(rows_)) for c in b.columns)], names=["g", *b.schema.names])

    def search(q_: pa.Table, c_: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        order = np.argsort(-c_.column("top").to_numpy(), kind="stable").tolist()
        get = lambda t, i, shape: np.frombuffer(t.column("data")[i].as_py(), t.column("kind")[i].as_py()).astype(np.float64).reshape(shape)
        for j in range(len(q_) if order else 0):
            dim = q_.column("dim")[j].as_py()
            q_id, q_pos = (np.frombuffer(q_.column(x)[j].as_buffer(), np.int64) for x in ("ids", "places"))
            q = get(q_, j, (len(q_id), dim))
            bound = np.frombuffer(q_.column("bounds")[j].as_buffer(), np.float64).copy()
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_id)
            for i in order:
                c_id = np.frombuffer(c_.column("ids")[i].as_buffer(), np.int64)
                _search_block(q, q_id, bound, get(c_, i, (len(c_id), dim)), c_id, k, coordinate_from, focus, best)
            found.extend((np.full(len(s), place), np.full(len(s), key), own, s) for place, key, (s, own) in zip(q_pos, q_id, best, strict=True))
        return pa.table({name: pa.array(np.concatenate([x[i] for x in found])) for i, name in enumerate(("pos", "query_id", "vec_id", "score"))})

    to = blocks.mapInArrow(send, "qb int, dim int, g int, top double, ids binary, kind string, data binary")
    from_ = queries.mapInArrow(meet, "g int, dim int, qb int, least double, ids binary, places binary, kind string, data binary, bounds binary")
    found = from_.groupBy("dim", "qb", "g").cogroup(to.groupBy("dim", "qb", "g")).applyInArrow(search, "pos long, query_id long, vec_id long, score long")
    place_ = F.row_number().over(W.partitionBy("pos").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place_).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, F.col("id") % 20 == 0)

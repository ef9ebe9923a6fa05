"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows get the number of their place (partition and position) and are written once, so that later steps see the same rows in
the same places whatever is lost; all orders below are by that number, which no two rows share. A unit is up to `unit_rows`
neighbouring rows of a partition. Shard sizes are fixed first (counts at most one apart). How many rows of each unit go to
each shard is drawn without replacement, as a random deal would give them (multivariate hypergeometric), in two
levels: the driver draws for at most `most_groups` groups of units, and each group draws for its units in a task. Each
unit permutes its rows and hands out the counts; a row then has its place among the rows sent to its shard, a keyed
bijection of the shard's places spreads them over cells of `cell_rows`, the rows are exchanged, and each cell permutes again.

A draw sums the weights of all outcomes outwards from the likeliest, by their ratios, until they no longer count in double
precision; it is one method at all sizes, right to about 1e-12 of each probability. The driver holds groups x shards numbers;
units and cells bound what a task holds, and no value of a row decides where it goes, so hot keys and equal rows spread
evenly.

Cases: null text has no bytes; null ids, ties, repeated rows and very long texts are rows like any other; fewer rows than shards
leave some shards empty; an empty table gives an empty one. Extra columns, nested ones too, are carried along unless they have the
name of a result column (shard, slot), which then replaces them. Column names that start with __vellum_ are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

PLACE, UNIT, GROUP, CELL = "__vellum_place", "__vellum_unit", "__vellum_group", "__vellum_cell"


def _weights(ratio, at: int, end: int, step: int, width: int) -> np.ndarray:
    """Weights of the outcomes from `at` to `end` as products of ratios to the one before, until they no longer count."""
    parts, last = [], 1.0
    while (end - at) * step >= 0 and last > 1e-25:
        k = np.arange(at, (min(at + width - 1, end) if step > 0 else max(at - width + 1, end)) + step, step, dtype=np.float64)
        parts.append(last * np.cumprod(ratio(k)))
        last, at = float(parts[-1][-1]), int(k[-1]) + step
    return np.concatenate([np.zeros(0), *parts])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in a sample without replacement, for populations of any size below 2**53."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    width = int(min(sample, good, bad) ** 0.5) + 64
    up = _weights(lambda k: (good - k + 1) * (sample - k + 1) / (k * (bad - sample + k)), mode + 1, high, 1, width)
    down = _weights(lambda k: (k + 1) * (bad - sample + k + 1) / ((good - k) * (sample - k)), mode - 1, low, -1, width)
    sums = np.cumsum(np.concatenate([[1.0], up, down]))
    i = min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(sums) - 1)
    return mode + i if i <= len(up) else mode - (i - len(up))


def communication_matrix(counts: list[int], sizes: list[int], seed) -> np.ndarray:
    """[row, shard] counts with these row and column sums, as a uniform shuffle would give them."""
    rng, left = np.random.default_rng(seed), list(sizes)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        rest = sum(left)
        for k, room in enumerate(left):
            take = hypergeometric(rng, room, rest - room, n)
            out[i, k], rest, n = take, rest - room, n - take
            left[k] -= take
    return out


def scattered(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 .. size-1: a Feistel network, walked until it ends inside."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for turn in range(6):
            f = (b + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xC4CEB9FE1A85EC53)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    v = once(x.astype(np.uint64))
    while (out := v >= size).any():
        v[out] = once(v[out])
    return v.astype(np.int64)


def plan_units(units: DataFrame, shards: int, sizes: list[int], seed: int, most_groups: int = 1024) -> DataFrame:
    """(UNIT, counts, start): rows of each unit (UNIT, n) for each shard, and their first place in it."""
    groups = max(1, min(most_groups, units.count() // 16))
    dealt = units.withColumn(GROUP, F.pmod(F.xxhash64(UNIT), F.lit(groups)).cast("int"))
    totals = sorted((r[GROUP], r["n"]) for r in dealt.groupBy(GROUP).agg(F.sum("n").alias("n")).collect())
    matrix = communication_matrix([n for _, n in totals], sizes, [seed, 0])
    first = np.cumsum(matrix, axis=0) - matrix
    told = {g: (matrix[i], first[i]) for i, (g, _) in enumerate(totals)}

    def draw(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own, start = told[key[0].as_py()]
        t = t.sort_by(UNIT)
        m = communication_matrix(t.column("n").to_pylist(), own.tolist(), [seed, 1, key[0].as_py()])
        return pa.table({UNIT: t.column(UNIT), "counts": pa.array(m.tolist(), pa.list_(pa.int64())), "start": pa.array((start + np.cumsum(m, axis=0) - m).tolist(), pa.list_(pa.int64()))})

    return dealt.groupBy(GROUP).applyInArrow(draw, f"{UNIT} long, counts array<long>, start array<long>")


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 17, cell_rows: int = 4096, unit_rows: int = 1 << 17) -> DataFrame:
    """Rows of `df` with shard (0 .. shards-1) and slot (0 .. size of the shard - 1)."""
    keep = [f for f in df.schema.fields if f.name not in ("shard", "slot")]
    names = [f.name for f in keep]
    table = written(df.select(*names, F.monotonically_increasing_id().alias(PLACE)), "places")
    # a place is the partition's number and 33 bits of position
    table = table.withColumn(UNIT, F.shiftright(PLACE, 33) * F.lit(-(-(1 << 33) // unit_rows)) + F.floor(F.col(PLACE).bitwiseAND((1 << 33) - 1) / F.lit(unit_rows)))
    units = written(table.groupBy(UNIT).agg(F.count(F.lit(1)).alias("n")), "units")
    n = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    plan = plan_units(units, shards, sizes, seed)

    def deal(t: pa.Table, own: pa.Table) -> pa.Table:
        unit = own.column(UNIT)[0].as_py()
        counts, first = (np.array(own.column(c)[0].as_py(), np.int64) for c in ("counts", "start"))
        t = t.drop_columns([UNIT]).sort_by(PLACE).take(pa.array(np.random.default_rng([seed, 2, unit]).permutation(len(t))))
        shard = np.repeat(np.arange(shards), counts)
        place = np.concatenate([np.zeros(0, np.int64), *(scattered(first[k] + np.arange(counts[k]), sizes[k], seed * shards + k) for k in range(shards))])
        return t.append_column("shard", pa.array(shard.astype(np.int32))).append_column(CELL, pa.array(place // cell_rows))

    def again(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        shard, cell = key[0].as_py(), key[1].as_py()
        order = np.random.default_rng([seed, 3, shard, cell]).permutation(len(t))
        return t.sort_by(PLACE).drop_columns([CELL, PLACE]).append_column("slot", pa.array(cell * cell_rows + order))

    schema = T.StructType([*keep, T.StructField("shard", T.IntegerType())])
    moved = T.StructType([*keep, T.StructField(PLACE, T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField(CELL, T.LongType())])
    dealt = table.groupBy(UNIT).cogroup(plan.groupBy(UNIT)).applyInArrow(deal, moved)
    return dealt.groupBy("shard", CELL).applyInArrow(again, T.StructType([*schema.fields, T.StructField("slot", T.LongType())]))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Law `rows`: counts of the shards are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

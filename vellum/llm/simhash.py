"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprint: bit i is set if over half of a text's word shingles have bit i set in their XXH64.
Fingerprints are dealt into ranges of Gray rank (neighbours there differ in few bits). A
node stands for a run of fingerprints and holds the bits they share: mask and pattern. A
fingerprint that differs from a pattern in more than `distance` masked bits differs from every
member by more, so the whole run is pruned; children hold more shared bits, and the differences
add up on the way down. The upper nodes are in every task and tell which ranges a fingerprint has to visit; each range
then has its own tree down to the single members.

A large distance leaves one Gray order little to prune. With `turns` = t the index has t orders, in each of which
another of t blocks of the 64 bits leads; two fingerprints within d bits differ in at most d // t bits of one block, so in
each order a run is also pruned by its differences in the leading block alone.

The search is exact. A fingerprint goes to about 1 + b + b*b/2 ranges for 2**b ranges at two bits, so traffic grows as
the input times log squared. A range of distinct fingerprints returns the edges of a star for each local component, never
all pairs, and exact copies are one fingerprint from the start. Ranges hold about `group_size` fingerprints, and up to 16 times as
many from 2**14 ranges on; the upper nodes take 18 bytes a range: 12 MB for 4e10 fingerprints.

Cases: null, empty and blank texts have fingerprint 0 and are linked to each other and to anything within the
distance; texts shorter than a shingle have the one shingle of all their words; very long texts are one part of a batch; of
ids that tie there is no choice, the smallest names the component; null ids never name a
component unless it has no other id; repeated rows each come back; an empty table gives an empty one. The result has the id,
fingerprint and component_id only, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import written
from .graph import connected_components

FP = "__vellum_fp"


def shingle_hashes(words: K.Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the space-joined lower-case shingles, and how many each document has."""
    buf, offs, _ = words.joined(lower=True)
    w = K.Words(buf, offs)
    n = np.where(w.count >= size, w.count - size + 1, np.minimum(w.count, 1))
    first = np.repeat(w.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + size, np.repeat(w.first[1:], n)) - 1
    data, h = buf.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((h(data[a:b], seed) for a, b in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)), np.uint64, len(first)), n


def fingerprints_of(texts: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for _, part in K.slices(texts, 1 << 20):
        h, n = shingle_hashes(K.words_of(part), size, seed)
        fp = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
            fp[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        out.append(fp)
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = 3, seed: int = 42, name: str = FP) -> DataFrame:
    """Rows of `docs` without their text, with the fingerprint's 64 bits as a long."""
    keep = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        for batch in batches:
            fp = fingerprints_of(K.column(batch.column(text)), size, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fp)], names=[*keep, name])

    return docs.mapInArrow(K.tidy(run), T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.LongType())]))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Tree:
    """Nodes over runs of words in Gray order, by level from the top; `fan` children each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, fan: int = 8):
        """low, high: AND and OR of the members of each lowest node, in Gray order."""
        self.fan, self.levels = fan, []
        while True:
            self.levels.insert(0, (~(low ^ high), low & ~(low ^ high)))
            if len(low) <= fan:
                break
            cut = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)

    def search(self, words: np.ndarray, distance: int, lead: int = 64, lead_distance: int | None = None, at_once: int = 1024):
        """Yields arrays (word, lowest node) of all nodes that differ in at most `distance` shared bits, and in at most
        lead_distance of those among the `lead` highest bits."""
        first = np.uint64((1 << 64) - (1 << 64 - lead))
        most = distance if lead_distance is None else lead_distance
        for start in range(0, len(words), at_once):
            part = words[start : start + at_once]
            top = len(self.levels[0][0])
            word, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    word = np.repeat(word, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    real = node < len(mask)
                    word, node = word[real], node[real]
                differ = (part[word] ^ pattern[node]) & mask[node]
                near = np.bitwise_count(differ) <= distance
                if most < distance:
                    near &= np.bitwise_count(differ & first) <= most
                word, node = word[near], node[near]
            yield word + start, node


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _local_links(group: np.ndarray, guests: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links among the words of a group, and between its words and the guests."""
    group = group[np.argsort(gray_rank(group), kind="stable")]
    words, tree = np.concatenate([group, guests]), Tree(group, group)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for word, member in tree.search(words, distance):
        new = word > member
        a.append(word[new])
        b.append(member[new])
    a, b = np.concatenate(a), np.concatenate(b)
    root = stars(a, b, len(words))
    moved = np.flatnonzero(root != np.arange(len(words)))
    return words[moved], words[root[moved]]


def rotated(fp: Column, by: int) -> Column:
    """A long with its bits turned left, so that bit 63 - by leads."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def visits(fps: DataFrame, distance: int, carried: tuple[str, ...] = (), turn: int = 0, turns: int = 1, group_size: int = 4096, least_groups: int = 64) -> DataFrame:
    """(g, guest, fp, *carried as packed 64-bit words): the fingerprints (long) that meet in range g of one Gray order: its own and
    the guests of lower ranges. Every two fingerprints within `distance` whose leading blocks allow it meet in a range."""
    n = fps.count()
    groups = max(least_groups, -(-n // group_size) if n <= group_size << 14 else max(1 << 14, -(-n // (16 * group_size))))
    lead = (turn + 1) * 64 // turns - turn * 64 // turns
    turned = fps.select(rotated(F.col("fp"), turn * 64 // turns).alias("fp"), *carried)
    sample = turned.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(8 * groups).toPandas().fp.to_numpy()
    ranks = np.sort(gray_rank(sample.astype(np.int64).view(np.uint64)))
    pivots = np.unique(ranks[np.arange(1, groups) * len(ranks) // groups]) if len(ranks) else ranks
    names = ["fp", *carried]

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(pivots, gray_rank(fp.view(np.uint64)), "right").astype(np.int32)), *(batch.column(c) for c in names)], names=["g", *names])

    dealt = written(turned.mapInArrow(deal, "g int, " + ", ".join(f"{c} long" for c in names)), "gray")
    nodes = dealt.groupBy("g").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")).orderBy("g").toPandas()
    number = nodes.g.to_numpy()
    upper = Tree(nodes.low.to_numpy(np.int64).view(np.uint64), nodes.high.to_numpy(np.int64).view(np.uint64)) if len(nodes) else None

    def route(batches):
        """Each batch's own and guest fingerprints, packed by the range that they visit."""
        K.lean()
        for batch in (b for b in batches if b.num_rows):
            fp, own = batch.column("fp").to_numpy(), batch.column("g").to_numpy()
            found = [(number[node], word) for word, node in upper.search(fp.view(np.uint64), distance, lead, distance // turns)]
            to, word = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (own[:0], own[:0])
            take = to >= own[word]
            to, word = to[take], word[take]
            key = 2 * to.astype(np.int64) + (to > own[word])
            order = np.argsort(key, kind="stable")
            key, word = key[order], word[order]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            packed = [pa.array([col[x].tobytes() for x in np.split(word, cut[1:])] if len(cut) else [], pa.binary()) for col in (batch.column(c).to_numpy() for c in names)]
            yield pa.RecordBatch.from_arrays([pa.array((key[cut] >> 1).astype(np.int32)), pa.array((key[cut] & 1) == 1), *packed], names=["g", "guest", *names])

    return dealt.mapInArrow(K.tidy(route), "g int, guest boolean, " + ", ".join(f"{c} binary" for c in names))


def met(table: pa.Table, column: str) -> tuple[np.ndarray, int]:
    """A packed column of visits() of one range: own values first; and how many are own."""
    own, guests = (b"".join(table.filter(pc.equal(table.column("guest"), x)).column(column).to_pylist()) for x in (False, True))
    return np.frombuffer(own + guests, np.int64), len(own) // 8


def near_links(fps: DataFrame, distance: int = 2, group_size: int = 4096, least_groups: int = 64) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) linked at `distance` or fewer bits.

    Ranges number least_groups at least, so that small inputs keep all executors busy too."""

    def link(table: pa.Table) -> pa.Table:
        K.lean()
        words, own = met(table, "fp")
        words = words.view(np.uint64)
        a, b = _local_links(words[:own], words[own:], distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return visits(fps, distance, group_size=group_size, least_groups=least_groups).groupBy("g").applyInArrow(K.tidy(link), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row for each row of `docs`: its id, fingerprint (long) and component_id, the smallest id reachable."""
    prints = written(with_fingerprint(docs.select(id_col, text), text, size, seed, "fp"), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    first = written(first, "distinct")
    roots = written(connected_components(near_links(first, distance)).withColumnRenamed("node", "fp"), "roots")
    least = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least, "root").select("fp", "least")
    named = written(first.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    return prints.join(named, "fp").select(id_col, F.col("fp").alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

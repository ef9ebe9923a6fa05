"""Queue, cache, retry and debounce behaviour over a log of requests, in batch form.

All forms are prefix computations. A long history is cut into blocks of time; a block is summed up in a bounded state (queue:
two numbers; cache: its last keys), the states are combined in order, and each block is replayed from the state before
it. So one server's history is not one task's work, and the result equals a simulation event by event.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def queue_finish(events: DataFrame, server: str, at: str, order: str, service: Column, block: Column) -> DataFrame:
    """finish: when each request ends on a server that takes one at a time, first come first served. Times are longs:
    finish_i = C_i + max over j <= i of (arrival_j - C_(j-1)), C the running sum of service times."""
    df = events.withColumns({"__s": service.cast("long"), "__b": block})
    inside = W.partitionBy(server, "__b").orderBy(at, order)
    df = df.withColumn("__c", F.sum("__s").over(inside)).withColumn("__m", F.max(F.col(at) - F.col("__c") + F.col("__s")).over(inside))
    blocks = df.groupBy(server, "__b").agg(F.sum("__s").alias("c"), F.max("__m").alias("m"))
    before = W.partitionBy(server).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0)))
    blocks = blocks.withColumn("m0", F.max(F.col("m") - F.col("c0")).over(before)).select(server, "__b", "c0", "m0")
    out = df.join(blocks, [server, "__b"])
    return out.withColumn("finish", F.col("__c") + F.col("c0") + F.greatest(F.col("__m") - F.col("c0"), F.col("m0"))).drop("__s", "__b", "__c", "__m", "c0", "m0")


def _folded(rows: DataFrame, group: list[str], order: list, begin, step, schema: str) -> DataFrame:
    """step(state, row) -> (state, output rows) over the rows of each group in order, from begin(). A partition is sorted and read as
    a stream with one state at a time, so a group's length costs no memory; row is a tuple in the order of the columns."""
    at = [rows.columns.index(g) for g in group]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(row[i] for i in at)
                if own != now:
                    now, state = own, begin()
                state, made = step(state, row)
                out.extend(made)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).types
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def lru_hits(events: DataFrame, server: str, key: Column, at: str, order: str, block: Column, limit: int = 12) -> DataFrame:
    """hit: whether the key was among the last `limit` distinct keys of its server; a null key is a key of its own.

    The last keys of each block of time are found first; read in order they give each block's starting keys, and these go before
    the block's events as rows. Blocks are then replayed apart from each other."""
    kind = dict(events.dtypes)
    df = events.select(F.col(server).alias("s"), block.alias("b"), key.cast("string").alias("k"), F.col(at).cast("long").alias("at"), F.col(order).alias("ord"), F.lit(1).alias("event"))
    newest = F.row_number().over(W.partitionBy("s", "b").orderBy(F.desc("t")))
    last = df.groupBy("s", "b", "k").agg(F.max(F.struct("at", "ord")).alias("t")).withColumn("age", newest).where(F.col("age") <= limit)

    def start(state, row):
        (known, keys), (_, b, k, age) = state, row
        made = [] if known == b else [(row[0], b, x, i) for i, x in enumerate(keys)]
        return (b, [k, *(x for x in keys if x != k)][:limit]), made

    starts = _folded(last.select("s", "b", "k", "age"), ["s"], ["b", F.desc("age")], lambda: (None, []), start, f"s {kind[server]}, b long, k string, age int")
    before = starts.select("s", "b", "k", F.lit(0).cast("long").alias("at"), (-F.col("age")).cast(kind[order]).alias("ord"), F.lit(0).alias("event"))

    def replay(keys, row):
        _, _, k, _, ord_, event = row
        return [k, *(x for x in keys if x != k)][:limit], [(ord_, k, k in keys)] if event else []

    return _folded(df.unionByName(before), ["s", "b"], ["event", "at", "ord"], list, replay, f"{order} {kind[order]}, key string, hit boolean")


def in_flight(events: DataFrame, key: list[str], at: str, order: str, service: Column, block: Column) -> DataFrame:
    """joined: whether a request finds one with its key still running and waits for that instead of starting.

    A request that comes when all earlier ones of its key would have ended starts anew whatever they did, so a key's history falls
    apart there; the maxima and counts that tell are prefixes over blocks of time. The parts are replayed apart from each other."""
    kind, group = dict(events.dtypes), [f"__k{i}" for i in range(len(key))]
    df = events.select(*[F.col(k).alias(g) for k, g in zip(key, group, strict=True)], block.alias("__b"), F.col(at).cast("long").alias("__at"), F.col(order).alias("__ord"), service.cast("long").alias("__s"))
    inside = W.partitionBy(*group, "__b").orderBy("__at", "__ord")
    earlier = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)

    def with_prefix(df: DataFrame, total: Column, prefix) -> DataFrame:
        blocks = df.groupBy(*group, "__b").agg(total.alias("__x")).select(*[F.col(c).alias(f"{c}_") for c in (*group, "__b")], prefix("__x").over(earlier).alias("__before"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*group, "__b")]
        return df.join(blocks, same).drop(*[f"{c}_" for c in (*group, "__b")])

    end = F.col("__at") + F.col("__s")
    df = with_prefix(df, F.max(end), F.max).withColumn("__m", F.max(end).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumn("__new", F.coalesce(F.col("__at") >= F.greatest("__m", "__before"), F.lit(True)).cast("long")).drop("__before", "__m")
    df = with_prefix(df, F.sum("__new"), F.sum).withColumn("__part", F.coalesce("__before", F.lit(0)) + F.sum("__new").over(inside))

    def replay(end, row):
        at_, ord_, s = row[-3:]
        late = end is not None and at_ < end
        return end if late else at_ + s, [(ord_, late)]

    return _folded(df.select(*group, "__part", "__at", "__ord", "__s"), [*group, "__part"], ["__at", "__ord"], lambda: None, replay, f"{order} {kind[order]}, joined boolean")


def debounced(events: DataFrame, key: list[str], at: str, order: str, delay: int) -> DataFrame:
    """Events after which their key is quiet for longer than delay, and the last of each key."""
    nxt = F.lead(at).over(W.partitionBy(*key).orderBy(at, order))
    return events.withColumn("__n", nxt).where(F.col("__n").isNull() | (F.col("__n") - F.col(at) > delay)).drop("__n")


def retries(events: DataFrame, order: str, base: int = 3000, most: int = 3, jitter: int = 1000) -> DataFrame:
    """(…, attempt, delay): waiting times of the retries, doubling, with jitter fixed by the event."""
    n = F.explode(F.sequence(F.lit(1), F.lit(most)))
    return events.withColumn("attempt", n).withColumn("delay", (base * F.pow(F.lit(2), F.col("attempt") - 1)).cast("long") + F.pmod(F.col(order) * 7919 + F.col("attempt") * 104729, F.lit(jitter)))


def provider_attempts(attempts: DataFrame, provider: str, page: str, attempt: str, outcome: str, most: int = 3) -> DataFrame:
    """(…, made, wait_ms, disables): which attempts of a provider happen, how long it waits after each, and the one that ends its use.
    A page's attempts end with the first `accepted`; an `error` waits, 1.5 seconds longer each time and 4 at most; an error in the last
    attempt disables the provider for all later pages. Whether an attempt would disable depends on its page alone, and the first
    one that would does, so no history is folded."""
    own = W.partitionBy(provider, page).orderBy(attempt).rowsBetween(W.unboundedPreceding, -1)
    error = F.coalesce(F.col(outcome) == "error", F.lit(False))
    df = attempts.withColumn("made", ~F.coalesce(F.max(F.col(outcome) == "accepted").over(own), F.lit(False)))
    ends = df.where(F.col("made") & error & (F.col(attempt) == most)).groupBy(provider).agg(F.min(page).alias("__end"))
    df = df.join(ends, provider, "left").withColumn("made", F.col("made") & (F.col("__end").isNull() | (F.col(page) <= F.col("__end"))))
    waits = F.when(F.col("made") & error & (F.col(attempt) < most), F.least(F.lit(4000), F.col(attempt) * 1500)).otherwise(0).cast("int")
    return df.withColumns({"wait_ms": waits, "disables": F.col("made") & error & (F.col(attempt) == most)}).drop("__end")


def negative_cache(events: DataFrame, key: list[str], at: str, order: str, ttl: int) -> DataFrame:
    """known_miss: whether the key's event before is at most ttl ago."""
    before = F.lag(at).over(W.partitionBy(*key).orderBy(at, order))
    return events.withColumn("known_miss", F.coalesce(F.col(at) - before < ttl, F.lit(False)))


def key_order(keys: Column, cursor: Column, disabled: Column) -> Column:
    """Places (from 1) of a provider's keys in the order to try: from the cursor on, round, without disabled ones."""
    n = F.size(keys)
    start = F.pmod(cursor, F.greatest(F.lit(1), n))
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: F.pmod(start + i, n) + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda p: ~F.array_contains(disabled, p))


def lookup(requests: DataFrame, cached: DataFrame, running: DataFrame, key: str) -> DataFrame:
    """state: hit, in_flight or miss, by the keys that are cached and those that run."""
    c, r = cached.select(key).distinct().withColumn("__c", F.lit(True)), running.select(key).distinct().withColumn("__r", F.lit(True))
    return requests.join(c, key, "left").join(r, key, "left").withColumn("state", F.when(F.col("__c"), "hit").when(F.col("__r"), "in_flight").otherwise("miss")).drop("__c", "__r")

"""Streaming forms: a bounded LRU cache for each server, and windowed counts with a watermark for late rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def lru_hits(stream: DataFrame, server: str, limit: int = 12) -> DataFrame:
    """(event_id, key, hit) of a stream of (server, at, event_id, key). The state of a server is its last `limit` keys; within
    a micro-batch rows are taken in order of time. Servers spread over the cluster, one server is one state."""

    def step(group, frames, state):
        keys = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable")
        hits = []
        for key in rows["key"]:
            hits.append(key in keys)
            keys = [key, *(k for k in keys if k != key)][:limit]
        state.update((keys,))
        yield pd.DataFrame({"event_id": rows["event_id"], "key": rows["key"], "hit": hits})

    return stream.groupBy(server).applyInPandasWithState(step, "event_id long, key string, hit boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(stream: DataFrame, at: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests and their mean service time by window and type; rows later than `late` are left out by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, into Parquet files."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

"""Streams of interactions: sessions, running ratings, expiring memory and ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a row may come, and the gap that ends a session.
LATENESS, GAP = "10 minutes", "30 minutes"


def session_windows(log: DataFrame, user: str = "user_id", at: str = "ts", lateness: str = LATENESS, gap: str = GAP) -> DataFrame:
    """user, start, end and events of the sessions of a log, streaming or not. Times without a zone are UTC."""
    rows = log.withColumn("__at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("__at", lateness) if rows.isStreaming else rows
    grouped = rows.groupBy(user, F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def running_counts(log: DataFrame, key: str, kind: str) -> DataFrame:
    """key, kind and n: counters for output mode "update" or "complete"."""
    return log.groupBy(key, kind).agg(F.count("*").alias("n"))


def remembered(log: DataFrame, user: str, item: str, at: str, minutes: int = 30) -> DataFrame:
    """user and fresh: how many different items each user has fetched within the last minutes, after each batch; state expires with event time."""
    kind = {f.name: f.dataType.simpleString() for f in log.schema}
    ttl = pd.Timedelta(minutes=minutes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get)) if state.exists else {}
        for f in frames:
            for i, t in zip(f[item], f["__at"]):
                held[i] = max(held.get(i, 0), int(t.timestamp()))
        last = max(held.values())
        held = {i: t for i, t in held.items() if t > last - ttl.total_seconds()}
        state.update((list(held), list(held.values())))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(watermark + 1, (last + int(ttl.total_seconds())) * 1000))
        yield pd.DataFrame({user: [key[0]], "fresh": [len(held)]})

    rows = log.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", LATENESS)
    return rows.groupBy(user).applyInPandasWithState(step, f"{user} {kind[user]}, fresh int", f"items array<{kind[item]}>, times array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Handle every batch of a source once, in order, until what is there now is done; the checkpoint lets a stopped ingest go on."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

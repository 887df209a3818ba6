"""Structured Streaming: trailing failure windows per key, tumbling counts, first occurrences by digest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "event_id long, user_id long, ip_address string, ts timestamp, failures int, limited boolean"


def failure_windows(events: DataFrame, seconds: int = 300, limit: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """events (event_id, user_id, ip_address, ts timestamp, kind) to one decision per failure.

    A user is known by name and address; a success clears their failures. State: the failures of the last window of
    each user and address. It goes when event time has passed the window.
    """

    def decide(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        span, out = seconds * 1_000_000, []
        stamps = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
        kinds, ids, times = rows["kind"].tolist(), rows["event_id"].tolist(), rows["ts"].tolist()
        for i, t in enumerate(stamps):
            if kinds[i] != "failure":
                held = []
                continue
            held = [x for x in held if x >= t - span] + [t]
            # rows at the same instant count each other, as in the batch window
            ahead = sum(1 for j in range(i + 1, len(stamps)) if stamps[j] == t and kinds[j] == "failure")
            n = sum(x <= t for x in held) + ahead
            out.append((ids[i], *key, times[i], n, n >= limit))
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(max(held) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "ip_address", "ts", "failures", "limited"])

    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("user_id", "ip_address").applyInPandasWithState(decide, DECISIONS, "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_counts(events: DataFrame, seconds: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """How many events each user has in each window; late rows beyond the watermark are left out."""
    rows = events.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds"), "user_id").agg(F.count("*").alias("events"))
    return rows.select(F.col("window.start").alias("start"), "user_id", "events")


def first_by_digest(files: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """files (data, ts and whatever else) without those whose digest came before within the watermark."""
    return files.withColumn("sha256", F.sha2("data", 256)).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["sha256"])

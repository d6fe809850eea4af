"""Presence as a stateful stream: heartbeats in, changes of state out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.operators.reach import EVICT_MS, STALE_MS

OUT = "session_id string, state string, at long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session: a heartbeat makes it live; silence makes it stale, then evicts it."""
    last, status = state.get if state.exists else (0, "")
    changes = []
    if state.hasTimedOut:
        gone, now = last + STALE_MS + EVICT_MS, state.getCurrentWatermarkMs()
        if status == "live":
            changes.append(("stale", last + STALE_MS))
        if gone <= now:
            changes.append(("evicted", gone))
            state.remove()
        else:
            state.update((last, "stale"))
            state.setTimeoutTimestamp(gone)
    else:
        for f in frames:
            last = max(last, int(f["at"].max()))
        if status != "live":
            changes.append(("live", last))
        state.update((last, "live"))
        state.setTimeoutTimestamp(max(last + STALE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], s, at) for s, at in changes], columns=["session_id", "state", "at"])


def changes(heartbeats: DataFrame) -> DataFrame:
    """State changes of a stream of heartbeats (``session_id``, ``ts``); late ones extend, never shorten, a life."""
    rows = heartbeats.withColumn("at", F.unix_millis("ts")).withWatermark("ts", "0 seconds")
    return rows.groupBy("session_id").applyInPandasWithState(_step, OUT, "last long, status string", "append", GroupStateTimeout.EventTimeTimeout)

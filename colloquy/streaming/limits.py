"""Limits as stateful streams: the folds of ``operators.reach`` with their state kept between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.operators import reach

TABLE = "key array<string>, level array<double>, last array<long>"


def _in_order(frames: Iterator[pd.DataFrame], *more: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", *more], kind="stable", ignore_index=True)


def rate_limited(requests: DataFrame, lanes: int = 1, most: int = reach.MOST_KEYS) -> DataFrame:
    """As ``reach.rate_limited_within`` for a stream of requests (``key``, ``at``, ``ts`` as event time).

    The state of a lane is its table of buckets. Once the watermark has passed the time at which the last of
    them is full again, the whole lane is forgotten: an absent table says the same.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(state.get[0], zip(state.get[1], state.get[2], strict=True), strict=True)) if state.exists else {}
        buckets = reach.Buckets(held, most)
        rows = _in_order(frames, "key")
        passed = [buckets.allow(k, int(at)) for k, at in zip(rows["key"], rows["at"], strict=True)]
        entries = buckets.entries
        state.update((list(entries), [float(v[0]) for v in entries.values()], [int(v[1]) for v in entries.values()]))
        full = max(last + (reach.BURST - level) * 60_000 / reach.PER_MINUTE for level, last in entries.values())
        state.setTimeoutTimestamp(max(int(full) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"lane": key[0], "key": rows["key"], "at": rows["at"], "passed": passed})

    rows = requests.withColumn("lane", reach.lane(F.col("key"), lanes)).withWatermark("ts", "0 seconds")
    return _folded(rows, "lane", step, "lane int, key string, at long, passed boolean", TABLE)


def wakes_sent(requests: DataFrame) -> DataFrame:
    """As ``reach.wakes_sent`` for a stream of requests (``session_id``, ``at``, ``ts``); a session is forgotten after the gap."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows, sent = _in_order(frames), []
        for at in rows["at"]:
            sent.append(last is None or at - last >= reach.WAKE_GAP_MS)
            last = int(at) if sent[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last + reach.WAKE_GAP_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": key[0], "at": rows["at"], "sent": sent})

    return _folded(requests.withWatermark("ts", "0 seconds"), "session_id", step, "session_id string, at long, sent boolean", "last long")


def _folded(rows: DataFrame, key: str, step: Callable, out: str, state: str) -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)

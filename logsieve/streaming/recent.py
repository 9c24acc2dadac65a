"""The last N events of every key, whatever their age: a window bounded by count.

The state of a key is a list of at most N events by time, and how many came in all; an event older than all of a full list does
not enter. A key that is idle is forgotten by a timer of event time. The state store must be the one that keeps
lists and timers: set `spark.sql.streaming.stateStore.providerClass` to STATE_STORE.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastEvents(StatefulProcessor):
    """Holds the last `size` events (time, id) of a key; of equal times the larger ids."""

    def __init__(self, size: int, keys: Sequence[str], idle_ms: int | None, content: bool):
        self.size, self.keys, self.idle_ms, self.content = size, list(keys), idle_ms, content

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "us long, id string")
        self.counts = handle.getValueState("counts", "seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.events.get()]
        seen = self.counts.get()[0] if self.counts.exists() else 0
        if self.idle_ms is not None and kept and kept[-1][0] // 1000 + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            kept, seen = [], 0  # was due to be forgotten when these rows came
        for batch in rows:
            seen += len(batch)
            kept += zip(batch["state_us"].tolist(), batch["state_id"].tolist(), strict=True)
            kept = sorted(kept)[-self.size :]  # never more than the window and one batch
        self.events.put(kept)
        self.counts.update((seen,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(kept[-1][0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        named = dict(zip(self.keys, key, strict=True))
        if self.content:
            yield pd.DataFrame({**{k: [v] * len(kept) for k, v in named.items()}, "seen": seen, "us": [us for us, _ in kept], "id": [i for _, i in kept]})
        else:
            yield pd.DataFrame([{**named, "seen": seen, "events": len(kept), "first_us": kept[0][0], "last_us": kept[-1][0]}])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.events.clear()
        self.counts.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_events(
    events: DataFrame, keys: Sequence[str], size: int = 10_000, ts: str = "ts", event_id: str = "event_id", idle_ms: int | None = None,
    delay: str = "4 hours", content: bool = False,
) -> DataFrame:
    """After each micro-batch, per key with new rows: seen (all so far), events, first_us and last_us of its last `size` events.

    With `content` the events themselves, one row each (us, id). Rows without a time are left out. With `idle_ms` a key whose last event is
    older than that by the watermark is forgotten, else none is.
    """
    kinds = dict(events.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    out = f"{named}, seen long, " + ("us long, id string" if content else "events long, first_us long, last_us long")
    rows = events.where(F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, delay) if idle_ms is not None else rows
    rows = rows.select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("state_us"), F.col(event_id).cast("string").alias("state_id"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        LastEvents(size, keys, idle_ms, content), out, "Append", "EventTime" if idle_ms is not None else "None"
    )

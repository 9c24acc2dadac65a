"""Detectors that keep a few numbers per key between micro-batches.

The state of a key has a fixed size: moments of its gaps, or the times of its last failures
up to the threshold. A row that arrives out of order within a batch is sorted in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _expire(state: GroupState, last_us: int | None, idle_ms: int) -> None:
    """Forget a key once event time has moved on by `idle_ms` since its last row."""
    seen = max(last_us // 1000 if last_us is not None else 0, state.getCurrentWatermarkMs())
    state.setTimeoutTimestamp(seen + idle_ms)


def beaconing(
    connections: DataFrame,
    keys: Sequence[str] = ("src", "dst"),
    ts: str = "ts",
    min_connections: int = 10,
    score_above: float = 0.8,
    idle_ms: int = 4 * 3600 * 1000,
    delay: str = "4 hours",
) -> DataFrame:
    """Keys whose gaps are regular so far, with count, mean gap and score, after each batch that shows them."""
    keys = list(keys)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, gaps, mean, m2, last = state.get if state.exists else (0, 0, 0.0, 0.0, None)
        for stamp in sorted(us for batch in batches for us in batch["_us"]):
            n += 1
            if last is not None and stamp > last:
                gap = (stamp - last) / 1e6
                gaps += 1
                step = gap - mean
                mean += step / gaps
                m2 += step * (gap - mean)
            last = stamp if last is None else max(last, stamp)
        state.update((n, gaps, mean, m2, last))
        _expire(state, last, idle_ms)
        if gaps and n > min_connections:
            deviation = (m2 / (gaps - 1)) ** 0.5 if gaps > 1 else 0.0
            score = 1.0 / (1.0 + deviation / mean)
            if score > score_above:
                row = dict(zip(keys, key, strict=True))
                yield pd.DataFrame([{**row, "connections": n, "mean_gap": mean, "beacon_score": score}])

    kinds = dict(connections.dtypes)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", connections long, mean_gap double, beacon_score double"
    timed = connections.withWatermark(ts, delay).select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    return timed.groupBy(*keys).applyInPandasWithState(
        update, out, "n long, gaps long, mean double, m2 double, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def brute_force(
    logins: DataFrame,
    keys: Sequence[str] = ("target", "source"),
    ts: str = "ts",
    failed: str = "failed",
    failures: int = 5,
    within_seconds: float = 600,
    idle_ms: int = 3600 * 1000,
    delay: str = "4 hours",
) -> DataFrame:
    """Successes after at least `failures` failures of the same key within the time window.

    Only the times of the last `failures` failures are kept: the oldest of them decides.
    """
    keys = list(keys)
    width = int(within_seconds * 1e6)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = sorted((int(us), not bad) for batch in batches for us, bad in zip(batch["_us"], batch["_failed"], strict=True))
        found = []
        for stamp, succeeded in rows:
            if not succeeded:
                recent = (recent + [stamp])[-failures:]
            elif len(recent) == failures and stamp - recent[0] <= width:
                found.append({**dict(zip(keys, key, strict=True)), "success_us": stamp, "first_failure_us": recent[0]})
        state.update((recent,))
        _expire(state, rows[-1][0] if rows else None, idle_ms)
        if found:
            yield pd.DataFrame(found)

    kinds = dict(logins.dtypes)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", success_us long, first_failure_us long"
    timed = logins.withWatermark(ts, delay).select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(failed).alias("_failed"))
    return timed.groupBy(*keys).applyInPandasWithState(update, out, "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)

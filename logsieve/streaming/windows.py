"""Continuous counterparts of the bucket, scan and sequence detectors.

Where the batch operators look at all events, these keep what the watermark allows: four
hours by default, the longest time any correlation rule looks back. Rows that arrive later
than that are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.predicates import event_id

LONGEST_RULE = "4 hours"


def event_window(events: DataFrame, ts: str = "ts", delay: str = LONGEST_RULE) -> DataFrame:
    return events.withWatermark(ts, delay)


def volume(events: DataFrame, is_error: Column, ts: str = "ts", size: str = "5 minutes") -> DataFrame:
    """Events, errors and their share per tumbling window; each window is emitted once, when it is complete."""
    window = F.window(ts, size)
    counts = events.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if(is_error).alias("errors"))
    return counts.select(
        F.col("w.start").alias("bucket"), "events", "errors", (F.col("errors") / F.col("events")).alias("error_rate")
    )


def scans(
    flows: DataFrame,
    value: str,
    src: str = "src",
    ts: str = "ts",
    size: str = "1 minute",
    slide: str = "10 seconds",
    at_least: int = 20,
    accuracy: float = 0.01,
) -> DataFrame:
    """Sources with many distinct ports or hosts in a sliding minute.

    A stream cannot count distinct values exactly; the count is a sketch with the given
    relative deviation, which also keeps the state of a busy source small.
    """
    counts = flows.groupBy(F.col(src), F.window(ts, size, slide).alias("w")).agg(
        F.approx_count_distinct(value, accuracy).alias("distinct_values"), F.count(F.lit(1)).alias("flows")
    )
    return counts.where(F.col("distinct_values") >= at_least).select(src, F.col("w.start").alias("bucket"), "distinct_values", "flows")


def bursts(events: DataFrame, key: str, ts: str = "ts", quiet: str = "1 hour", min_events: int = 10) -> DataFrame:
    """Runs of events of a key between quiet times."""
    sessions = events.groupBy(F.col(key), F.session_window(ts, quiet).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return sessions.where(F.col("events") >= min_events).select(
        key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("quiet_until"), "events"
    )


def distinct_events(
    events: DataFrame, ts: str = "ts", event_type: str = "event_type", source: str = "source", target: str | None = None
) -> DataFrame:
    """Each event once, by the digest of its time, type, source and target."""
    aim = F.col(target) if target else F.lit(None).cast("string")
    named = events.withColumn("id", event_id(F.col(ts), F.col(event_type), F.col(source), aim))
    return named.dropDuplicatesWithinWatermark(["id"])


def followed_by(
    first: DataFrame,
    then: DataFrame,
    keys: Sequence[str],
    within: str = "1 hour",
    ts: str = "ts",
    event_id_column: str = "event_id",
    delay: str = LONGEST_RULE,
) -> DataFrame:
    """First events joined with later events of the same key in (t, t + within], two streams or one read twice."""
    a = first.withWatermark(ts, delay).select(
        *[F.col(k).alias(f"a_{k}") for k in keys], F.col(ts).alias("first_ts"), F.col(event_id_column).alias("first_id")
    )
    b = then.withWatermark(ts, delay).select(
        *[F.col(k).alias(f"b_{k}") for k in keys], F.col(ts).alias("then_ts"), F.col(event_id_column).alias("then_id")
    )
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    in_time = (F.col("then_ts") > F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, same & in_time).select(*[F.col(f"a_{k}").alias(k) for k in keys], "first_id", "first_ts", "then_id", "then_ts")


def enrich(events: DataFrame, feed: DataFrame, value: str = "ioc_value") -> DataFrame:
    """Arriving rows with what a static feed says about their value."""
    return events.join(feed, value)


def match_rules(events: DataFrame, rules, keep: Sequence[str]) -> DataFrame:
    """Sigma-style rules without aggregates over arriving rows."""
    from logsieve.operators.sigma import sigma_match

    return sigma_match(events, [r for r in rules if not r.is_aggregate], keep)

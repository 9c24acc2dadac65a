"""Detectors over the gaps between events: rapid fire, automation, beacons, bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import normalize_message
from logsieve.operators.ordered import MICROS, gap_stats, micros


def rapid_fire(df: DataFrame, key: str = "source", ts: str = "ts", below: float = 0.1, min_events: int = 5) -> DataFrame:
    """Keys with two events closer than `below` seconds."""
    stats = gap_stats(df, [key], ts)
    return stats.where((F.col("n_events") >= min_events) & (F.col("min_gap") < below)).select(
        key, "n_events", "min_gap"
    )


def automated_activity(df: DataFrame, key: str = "source", ts: str = "ts", cv_below: float = 0.1, min_gaps: int = 10):
    """Keys whose gaps hardly vary."""
    cv = F.col("std_gap") / F.col("mean_gap")
    stats = gap_stats(df, [key], ts).where((F.col("n_gaps") > min_gaps) & (F.col("mean_gap") > 0) & (cv < cv_below))
    return stats.select(key, "n_events", (1 - cv).alias("regularity"), "mean_gap")


def beaconing(
    df: DataFrame,
    keys: Sequence[str] = ("src", "dst"),
    ts: str = "ts",
    min_connections: int = 10,
    score_above: float = 0.8,
) -> DataFrame:
    """Pairs that talk often and regularly: 1 / (1 + cv) over the gaps above zero."""
    cv = F.coalesce(F.col("std_positive_gap"), F.lit(0.0)) / F.col("mean_positive_gap")
    score = 1 / (1 + cv)
    stats = gap_stats(df, keys, ts).where(
        (F.col("n_events") > min_connections) & (F.col("n_events") >= 5) & (F.col("n_positive_gaps") > 0)
    )
    return stats.where(score > score_above).select(
        *keys, F.col("n_events").alias("connections"), score.alias("beacon_score"), "mean_positive_gap"
    )


def by_template(entries: DataFrame, message: str = "message") -> DataFrame:
    return entries.withColumn("template", normalize_message(F.col(message)))


def rapid_succession(df: DataFrame, key: str = "template", ts: str = "ts", within: float = 10.0, min_rapid: int = 5):
    stats = gap_stats(df, [key], ts, rapid_below=within)
    return stats.where((F.col("n_events") >= 5) & (F.col("rapid_gaps") >= min_rapid)).select(
        key,
        "n_events",
        "rapid_gaps",
        F.col("mean_gap").alias("average_interval"),
        F.least(F.col("rapid_gaps") / 10, F.lit(0.95)).alias("confidence"),
    )


def periodic(df: DataFrame, key: str = "template", ts: str = "ts", cv_below: float = 0.2, min_gaps: int = 4) -> DataFrame:
    cv = F.col("std_positive_gap") / F.col("mean_positive_gap")
    stats = gap_stats(df, [key], ts)
    return stats.where(
        (F.col("n_events") >= 5) & (F.col("n_positive_gaps") >= min_gaps) & (cv < cv_below)
    ).select(
        key, "n_events", F.col("mean_positive_gap").alias("period"), F.col("std_positive_gap").alias("deviation"),
        (1 - cv).alias("confidence"),
    )


def burst(
    df: DataFrame,
    key: str = "template",
    ts: str = "ts",
    quiet_seconds: float = 3600,
    burst_seconds: float = 300,
    min_events: int = 10,
) -> DataFrame:
    """A burst right after the widest quiet gap of a key, the first one on a tie."""
    stats = gap_stats(df, [key], ts).where((F.col("n_events") >= min_events) & (F.col("widest_gap") > quiet_seconds))
    width = int(burst_seconds * MICROS)
    slot = lambda us: F.floor(us / F.lit(width)).cast("long")
    start = F.col("widest_gap_end_us")
    # the window of a key touches two slots, so a busy key is joined slot by slot
    anchors = stats.select(
        key, start.alias("_start"), "widest_gap", F.explode(F.sequence(slot(start), slot(start + width))).alias("_slot")
    )
    events = (
        df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .select(key, micros(ts).alias("_us"))
        .groupBy(key, "_us")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_slot", slot(F.col("_us")))
    )
    joined = events.join(anchors, [key, "_slot"]).where(F.col("_us").between(F.col("_start"), F.col("_start") + width))
    return (
        joined.groupBy(key, "_start", "widest_gap")
        .agg(F.sum("_n").alias("burst_events"))
        .where(F.col("burst_events") >= min_events)
        .select(
            key,
            F.col("_start").alias("burst_start_us"),
            F.col("widest_gap").alias("quiet_seconds"),
            "burst_events",
            F.least(F.col("burst_events") / 20, F.lit(0.9)).alias("confidence"),
        )
    )


def c2_beacon(
    df: DataFrame, key: str = "dst", ts: str = "ts", min_connections: int = 5, min_gap: float = 30, spread: float = 0.3
) -> DataFrame:
    """Destinations contacted at a steady pace slower than `min_gap` seconds."""
    stats = gap_stats(df, [key], ts)
    deviation = F.coalesce(F.col("std_gap"), F.lit(0.0))
    return stats.where(
        (F.col("n_events") >= min_connections)
        & (F.col("mean_gap") > min_gap)
        & (deviation < F.col("mean_gap") * spread)
    ).select(
        key, F.col("n_events").alias("beacons"), F.col("mean_gap").alias("average_interval"), deviation.alias("deviation")
    )


def c2_communication(
    connections: DataFrame,
    processes: DataFrame,
    ts: str = "ts",
    keys: Sequence[str] = ("source", "destination"),
    min_events: int = 5,
    cv_below: float = 0.2,
    within_seconds: float = 4 * 3600,
    entities: Sequence[str] = ("source", "user", "parent_process"),
) -> DataFrame:
    """Regular pairs whose source also starts a process within four hours of the first contact."""
    source = keys[0]
    cv = F.col("pop_std_gap") / F.col("mean_gap")
    regular = gap_stats(connections, keys, ts).where(
        (F.col("n_events") >= min_events) & (F.col("mean_gap") > 0) & (cv < cv_below)
    ).select(*keys, "n_events", "mean_gap", cv.alias("cv"), "first_us")
    width = int(within_seconds * MICROS)
    slot = lambda us: F.floor(us / F.lit(width)).cast("long")
    present = [e for e in entities if e in processes.columns]
    started = (
        processes.select(
            F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(e) for e in present])))).alias("_entity"),
            micros(ts).alias("_us"),
        )
        .groupBy("_entity", "_us")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_slot", slot(F.col("_us")))
    )
    anchors = regular.withColumn(
        "_slot", F.explode(F.sequence(slot(F.col("first_us")), slot(F.col("first_us") + width)))
    )
    joined = anchors.join(
        started, (F.col(source) == F.col("_entity")) & (anchors["_slot"] == started["_slot"])
    ).where(F.col("_us").between(F.col("first_us"), F.col("first_us") + width))
    return joined.groupBy(*keys, "n_events", "mean_gap", "cv").agg(F.sum("_n").alias("process_events"))


def late_night(df: DataFrame, ts: str = "ts", hours: Sequence[int] = (0, 1, 2, 3, 4), over: int = 5) -> DataFrame:
    return (
        df.where(F.hour(ts).isin(*hours))
        .groupBy(F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("events"))
        .where(F.col("events") > over)
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    out = []
    for name, kind in df.dtypes:
        out.append(F.round(name, digits).alias(name) if kind == "double" else F.col(name))
    return df.select(*out)


"""Detectors over ordered series of measured values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.ordered import neighbour_frames, row_index
from logsieve.operators.stats import stat_outliers

SEGMENT_SECONDS = 6 * 3600


def ts_outliers(df: DataFrame, metric: str = "metric", value: str = "value", min_values: int = 10) -> DataFrame:
    """Outliers within each metric, with the range mean +/- 2 deviations."""
    found = stat_outliers(df, value, [metric], min_values=min_values)
    return found.select(
        *df.columns,
        "zscore",
        (F.col("mean_value") - 2 * F.col("std_value")).alias("expected_low"),
        (F.col("mean_value") + 2 * F.col("std_value")).alias("expected_high"),
    )


def trend_change(
    df: DataFrame,
    metric: str = "metric",
    value: str = "value",
    ts: str = "ts",
    order_by: Sequence[str] = ("ts",),
    window: int = 5,
    over: float = 0.5,
) -> DataFrame:
    """Positions where the mean of the next five values departs from that of the five before."""
    indexed = row_index(df, [metric], order_by, ts, segment_seconds=SEGMENT_SECONDS)
    framed = neighbour_frames(
        indexed,
        [metric],
        "row_index",
        before=window,
        after=window,
        frames={"before": (F.avg(value), -window, -1), "after": (F.avg(value), 0, window - 1)},
    )
    change = F.when(
        F.col("before") != 0, F.abs(F.col("after") - F.col("before")) / F.col("before")
    ).otherwise(F.lit(float("inf")))
    return (
        framed.where((F.col("row_index") >= window) & (F.col("row_index") < F.col("key_rows") - window))
        .withColumn("magnitude", change)
        .where(F.col("magnitude") > over)
        .drop("key_rows")
    )


def seasonal(
    df: DataFrame,
    metric: str = "metric",
    value: str = "value",
    ts: str = "ts",
    order_by: Sequence[str] = ("ts",),
    season: int = 24,
    over_rows: int = 100,
    deviation: float = 1.0,
) -> DataFrame:
    """Values far from the mean of their position in the season."""
    indexed = row_index(df, [metric], order_by, ts, segment_seconds=SEGMENT_SECONDS).where(F.col("key_rows") > over_rows)
    placed = indexed.withColumn("slot", F.col("row_index") % season)
    expected = placed.groupBy(metric, "slot").agg(F.avg(value).alias("expected"))
    # rounded, so that the order of summation does not decide a tie with the limit
    away = F.round(F.abs(F.col(value) - F.col("expected")) / F.col("expected"), 12)
    return placed.join(expected, [metric, "slot"]).where((F.col("expected") > 0) & (away > deviation)).withColumn(
        "deviation", away
    )

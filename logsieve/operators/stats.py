"""Outlier tests over numbers, exact and without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZSCORE = 3.0
IQR_MULTIPLIER = 1.5
MIN_VALUES = 3


def entropy_of_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy in bits of how the rows of each key spread over `value`."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # H = log2(N) - sum(n log2 n) / N, so one pass over the counts is enough
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("total"),
        F.count(F.lit(1)).alias("distinct_values"),
        (F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2(F.col("_n"))) / F.sum("_n")).alias("entropy"),
    )


QUARTILES = {"q1": (1, 4), "q3": (3, 4)}


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, positions: Mapping[str, tuple[int, int]] | None = None
) -> DataFrame:
    """`sorted[n * a // b]` of each key for every position (a, b), with mean, deviation and count.

    Equal values are counted first; positions are then found on the running count per
    value range, so the rows of one key are spread over its ranges.
    """
    keys = list(keys)
    wanted = dict(positions or QUARTILES)
    base = df.where(F.col(value).isNotNull())
    moments = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("std_value"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
    )
    counted = base.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    joined = _join(counted, moments, keys)
    width = (F.col("_high") - F.col("_low")) / 4096
    ranged = joined.withColumn(
        "_range", F.when(width > 0, F.floor((F.col(value) - F.col("_low")) / width)).otherwise(F.lit(0)).cast("long")
    )
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_range_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, "_range", F.coalesce(F.sum("_range_n").over(before), F.lit(0)).alias("_offset"), "_range_n"
    )
    places = {n: F.floor(F.col("n_values") * a / b) for n, (a, b) in wanted.items()}
    holds = F.lit(False)
    for place in places.values():
        holds = holds | ((place >= F.col("_offset")) & (place < F.col("_offset") + F.col("_range_n")))
    # only the ranges that hold a wanted position are looked into
    hits = _join(offsets, moments.select(*keys, "n_values"), keys).where(holds)
    inside = ranged.select(*keys, "_range", value, "_n").join(
        hits.select(*keys, "_range", "_offset"), [*keys, "_range"]
    )
    running = W.partitionBy(*keys, "_range").orderBy(value)
    upto = F.col("_offset") + F.sum("_n").over(running.rowsBetween(W.unboundedPreceding, 0))
    placed = _join(
        inside.select(*keys, value, "_n", upto.alias("_upto")), moments.select(*keys, "n_values"), keys
    )
    first = F.col("_upto") - F.col("_n")
    found = placed.groupBy(*keys).agg(
        *[F.max(F.when((at >= first) & (at < F.col("_upto")), F.col(value))).alias(n) for n, at in places.items()]
    )
    return _join(moments.drop("_low", "_high"), found, keys)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on the keys; without keys the right side is one aggregate row, read as a scalar."""
    if keys:
        return left.join(right, list(keys))
    row = right.select(F.struct(*right.columns).alias("row")).scalar()
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def with_scalars(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return _join(df, baseline, ())


def outlier_test(value: Column, zscore: float = ZSCORE, iqr: float = IQR_MULTIPLIER) -> Column:
    z = F.abs((value - F.col("mean_value")) / F.col("std_value"))
    spread = (F.col("q3") - F.col("q1")) * iqr
    outside = (value < F.col("q1") - spread) | (value > F.col("q3") + spread)
    return (F.col("n_values") >= MIN_VALUES) & (
        F.coalesce((F.col("std_value") > 0) & (z > zscore), F.lit(False)) | outside
    )


def stat_outliers(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    zscore: float = ZSCORE,
    iqr: float = IQR_MULTIPLIER,
    min_values: int = MIN_VALUES,
) -> DataFrame:
    """Rows whose value is far from the mean of its key or outside the quartile fences."""
    baseline = order_statistics(df, keys, value).where(F.col("n_values") >= min_values)
    tested = _join(df.where(F.col(value).isNotNull()), baseline, keys)
    return tested.where(outlier_test(F.col(value), zscore, iqr)).withColumn(
        "zscore", F.when(F.col("std_value") > 0, F.abs((F.col(value) - F.col("mean_value")) / F.col("std_value")))
    )

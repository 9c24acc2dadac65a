"""Distinct counts from stored sketches: one mergeable row per day and key, rolled up without reading the events again.

A sketch of 2**LG_K registers has a standard error of about 0.8 % and a fixed size, whatever it has counted; a key of few
values takes a few bytes. The exact counterparts are in `operators/fanout.py`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def _countable(value: Column) -> Column:
    """Sketches take whole numbers, strings and bytes; other values are counted by their text."""
    return value.cast("string")


def daily_sketches(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", lg_k: int = LG_K) -> DataFrame:
    """(day, keys, events, sketch): events counts all rows, the sketch the values that are not null.

    Rows without a time are of day null. The sketch is null where no row has a value.
    """
    counted = F.hll_sketch_agg(_countable(F.col(f"`{value}`")), lg_k)
    some = F.count(F.col(f"`{value}`")) > 0
    return df.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.count(F.lit(1)).alias("events"), F.when(some, counted).alias("sketch"))


def merged(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Several tables of daily sketches as one, so late events of a day are added by merging their own table."""
    first, *others = tables
    for other in others:
        first = first.unionByName(other)
    return _union(first, ["day", *keys])


def _union(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    held = F.col("sketch").isNotNull()
    joined = F.when(F.count_if(held) > 0, F.hll_union_agg("sketch"))
    return sketches.groupBy(*by).agg(F.sum("events").alias("events"), joined.alias("sketch"))


def distinct_between(
    sketches: DataFrame, keys: Sequence[str], name: str = "distinct_values", start: str | None = None, end: str | None = None, over: int = 0
) -> DataFrame:
    """(keys, events, `name`) over the days from `start` to `end`, both included, of the keys with more than `over` values.

    The filter on days reaches the scan of a table that is partitioned by day.
    """
    rows = sketches
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long")
    return _union(rows, keys).select(*keys, "events", estimate.alias(name)).where(F.col(name) > over)


def rolling_distinct(sketches: DataFrame, keys: Sequence[str], days: int, name: str = "distinct_values") -> DataFrame:
    """(day, keys, events, `name`) over the `days` days that end with each day that has events.

    A sketch goes to the days that it counts for and is merged there: `days` small rows for each stored one, no window
    over events. Rows of day null are left out.
    """
    dated = sketches.where(F.col("day").isNotNull())
    present = dated.select(F.col("day"), *keys, F.lit(True).alias("_own"))
    spread = dated.select(F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"), *keys, "events", "sketch")
    total = _union(spread, ["day", *keys])
    same = F.lit(True)
    for column in ("day", *keys):
        same = same & total[column].eqNullSafe(present[column])
    estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long")
    return total.join(present, same, "left_semi").select("day", *keys, "events", estimate.alias(name))

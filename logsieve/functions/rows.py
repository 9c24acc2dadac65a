"""Turning computed arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, keep: Sequence[str | Column], array: Column, name: str) -> DataFrame:
    """One row per element of an array that is costly to compute.

    A plain explode makes Spark infer a filter on the size of the array, which computes
    the array a second time below the projection. The outer form has no such filter; the
    rows of empty arrays are dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)

"""A history of analyses kept as a table partitioned by day: changes rewrite the days they touch, no others.

New rows of a day are written to the shared folder before the day is replaced, so a job that dies in between leaves the
table as it was. Rows are dealt by day, a large day over several tasks and files. The list of days (one row per day, whatever the number of analyses) comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.plans.history import apply_annotations
from logsieve.session import shared_path

DAY = "analysis_day"
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def dated(history: DataFrame) -> DataFrame:
    """With the day as the last column; analyses without a date are of 1970-01-01."""
    day = F.coalesce(F.to_date("analysis_date"), F.lit("1970-01-01").cast("date"))
    return history.drop(DAY).withColumn(DAY, day)


def create(history: DataFrame, table: str) -> None:
    """A new table, one folder a day."""
    dated(history).hint("rebalance", DAY).write.partitionBy(DAY).format("parquet").saveAsTable(table)


def append(history: DataFrame, table: str) -> None:
    dated(history).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).format("parquet").saveAsTable(table)


def days_of(rows: DataFrame) -> list[date]:
    return sorted(r[DAY] for r in rows.select(DAY).distinct().collect())


@contextmanager
def _only_days_written(spark: SparkSession) -> Iterator[None]:
    """Overwriting replaces the partitions that have new rows; a table's writer takes this from the session only."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def replace_days(spark: SparkSession, table: str, rows: DataFrame) -> list[date]:
    """Writes `rows` in place of what the table holds of their days; the days written."""
    path = shared_path(spark, "history-days")
    rows.write.parquet(path)
    ready = spark.read.schema(rows.schema).parquet(path)
    days = days_of(ready)
    if days:
        order = spark.table(table).columns
        with _only_days_written(spark):
            ready.select(*order).hint("rebalance", DAY).write.insertInto(table, overwrite=True)
    return days


def drop_days(spark: SparkSession, table: str, days: Sequence[date]) -> None:
    for day in days:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({DAY} = DATE'{day}')")


def _within(rows: DataFrame, days: Sequence[date]) -> DataFrame:
    """The rows of these days; the filter prunes folders."""
    return rows.where(F.col(DAY).isin(*days)) if days else rows.limit(0)


def annotate(spark: SparkSession, table: str, updates: DataFrame) -> list[date]:
    """Tags added and notes replaced by `updates(id, tags, notes, updated_at)`; the days rewritten.

    Ids that the table does not hold change nothing.
    """
    stored = spark.table(table)
    days = days_of(stored.select("id", DAY).join(updates.select("id").distinct(), "id", "left_semi"))
    changed = apply_annotations(_within(stored, days), updates).select(*stored.columns)
    return replace_days(spark, table, changed) if days else []


def retain(
    spark: SparkSession, table: str, newest: int | None = None, days: int | None = None, as_of: str | None = None, deleted: DataFrame | None = None
) -> tuple[list[date], list[date]]:
    """Removes deleted ids, rows more than `days` days before `as_of`, and all but the `newest` rows, each where asked for.

    In this order, as `history.retain` does. Days that keep all rows are not touched, those that keep none are dropped;
    only the day at a border and those of deleted ids are rewritten. Newest rows are found by counts per day, then a sort
    within the one day at the border. Gives (days rewritten, days dropped).
    """
    if days is not None and as_of is None:
        raise ValueError("days needs as_of")
    stored = spark.table(table)
    kept = stored if deleted is None else stored.join(deleted.select("id").distinct(), "id", "left_anti")
    if days is not None:
        kept = kept.where(F.col("analysis_date") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    left = {r[DAY]: r["n"] for r in kept.groupBy(DAY).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = {r[DAY]: r["n"] for r in stored.groupBy(DAY).agg(F.count(F.lit(1)).alias("n")).collect()}
    border, cut, room = None, 0, newest
    if newest is not None:
        for day in sorted(left, reverse=True):
            if left[day] > room:
                if room:
                    border, cut = day, room
                left[day] = room
            room -= left[day]
    dropped = sorted(d for d in before if not left.get(d))
    rewritten = sorted(d for d in before if left.get(d) and left[d] < before[d])
    whole = _within(kept, [d for d in rewritten if d != border])
    if border is not None:
        at_border = _within(kept, [border]).orderBy(F.desc("analysis_date"), F.desc("id")).limit(cut)
        whole = whole.unionByName(at_border)
    if rewritten:
        replace_days(spark, table, whole.select(*stored.columns))
    drop_days(spark, table, dropped)
    return rewritten, dropped

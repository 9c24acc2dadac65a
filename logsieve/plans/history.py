"""Search, statistics, comparison and upkeep of the history of analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def matching(
    history: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_score: int | None = None,
    severity: str | None = None,
    file_type: str | None = None,
    has_iocs: bool | None = None,
    search: str | None = None,
) -> DataFrame:
    """Rows that pass all filters given."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("analysis_date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (F.col("analysis_date") <= F.lit(end).cast("timestamp"))
    if min_score is not None:
        cond = cond & (F.coalesce("threat_score", F.lit(0)) >= min_score)
    if severity is not None:
        cond = cond & (F.col("severity") == severity)
    if file_type is not None:
        cond = cond & F.lower("file_type").contains(file_type.lower())
    if has_iocs is not None:
        cond = cond & ((F.coalesce("iocs_found", F.lit(0)) > 0) == F.lit(has_iocs))
    if search is not None:
        text = F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.coalesce("file_hash", F.lit("")), F.array_join("tags", " "))
        cond = cond & F.lower(text).contains(search.lower())
    return history.where(cond)


def page(rows: DataFrame, offset: int = 0, limit: int = 50, newest_first: bool = True) -> DataFrame:
    order = [F.desc("analysis_date"), F.desc("id")] if newest_first else ["analysis_date", "id"]
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.col("total") > offset + limit).alias("has_more")
    )


def since(history: DataFrame, days: int, as_of: Column) -> DataFrame:
    return history.where(F.col("analysis_date") >= as_of.cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def history_totals(history: DataFrame, days: int, as_of: Column) -> DataFrame:
    return since(history, days, as_of).agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if(F.col("threat_score") > 50).alias("threats_found"),
        F.coalesce(F.avg("threat_score"), F.lit(0.0)).alias("average_threat_score"),
    )


def history_counts(history: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Counts by severity, by type and by date in one pass, as (facet, value, n)."""
    rows = since(history, days, as_of).select(
        F.coalesce("severity", F.lit("unknown")).alias("by_severity"),
        F.split_part(F.coalesce("file_type", F.lit("unknown")), F.lit("/"), F.lit(1)).alias("by_file_type"),
        F.date_format("analysis_date", "yyyy-MM-dd").alias("by_date"),
    )
    names = ("by_severity", "by_file_type", "by_date")
    sets = rows.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n")
    )
    facet = F.when(F.col("_g") == 3, names[0]).when(F.col("_g") == 5, names[1]).otherwise(names[2])
    return sets.select(facet.alias("facet"), F.coalesce(*names).alias("value"), "n")


def top_techniques(history: DataFrame, days: int, as_of: Column, limit: int = 10) -> DataFrame:
    rows = since(history, days, as_of).select(F.explode("mitre_techniques").alias("technique"))
    return rows.groupBy("technique").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "technique").limit(limit)


def recent_high_threats(history: DataFrame, days: int, as_of: Column, limit: int = 10) -> DataFrame:
    rows = since(history, days, as_of).where(F.col("severity").isin("high", "critical"))
    return rows.orderBy(F.desc("analysis_date"), F.desc("id")).limit(limit)


def common_values(rows: DataFrame, ids: Sequence, key: str, value: str) -> DataFrame:
    """Values present in every one of the chosen analyses."""
    wanted = sorted(set(ids))
    return (
        rows.where(F.col(key).isin(*wanted))
        .groupBy(value)
        .agg(F.count_distinct(key).alias("_n"))
        .where(F.col("_n") == len(wanted))
        .select(value)
    )


def compare(history: DataFrame, ids: Sequence, iocs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(scores and counts side by side, common techniques, common indicators) of at least two analyses."""
    if len(set(ids)) < 2:
        raise ValueError("compare needs at least two analyses")
    chosen = history.where(F.col("id").isin(*ids))
    side = chosen.select("id", "file_name", "threat_score", "severity", "iocs_found", F.size("mitre_techniques").alias("techniques"))
    techniques = common_values(chosen.select("id", F.explode("mitre_techniques").alias("technique")), ids, "id", "technique")
    shared = common_values(iocs, ids, "file_id", "ioc_value") if iocs is not None else None
    return side, techniques, shared


def timeline(history: DataFrame, start: str, end: str) -> DataFrame:
    """Per day the number of analyses in total and by severity."""
    rows = matching(history, start, end).withColumn("day", F.date_format("analysis_date", "yyyy-MM-dd"))
    wide = rows.groupBy("day").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
    counts = {s: F.coalesce(s, F.lit(0)) for s in SEVERITIES}
    total = F.lit(0)
    for s in SEVERITIES:
        total = total + F.coalesce(s, F.lit(0))
    others = rows.groupBy("day").agg(F.count(F.lit(1)).alias("total"))
    return others.join(wide.select("day", *[c.alias(n) for n, c in counts.items()]), "day")


def apply_annotations(history: DataFrame, updates: DataFrame) -> DataFrame:
    """History with tags added and notes replaced by `updates(id, tags, notes, updated_at)`.

    Several updates of one analysis are folded first: all tags, the newest note.
    """
    tags = (
        updates.select("id", F.explode("tags").alias("_t")).distinct()
        .groupBy("id").agg(F.array_sort(F.collect_list("_t")).alias("_tags"))
    )
    newest = updates.where(F.col("notes").isNotNull()).groupBy("id").agg(F.max_by("notes", "updated_at").alias("_notes"))
    joined = history.join(tags, "id", "left").join(newest, "id", "left")
    return joined.withColumns(
        {
            "tags": F.array_union("tags", F.coalesce("_tags", F.array().cast("array<string>"))),
            "notes": F.coalesce("_notes", "notes"),
        }
    ).drop("_tags", "_notes")


def retain(
    history: DataFrame, newest: int | None = None, days: int | None = None, as_of: Column | None = None, deleted: DataFrame | None = None
) -> DataFrame:
    """History without deleted ids, rows older than `days` and all but the `newest` rows, each where asked for.

    The cut is a sort with a limit, which Spark takes per partition before merging.
    """
    kept = history
    if deleted is not None:
        kept = kept.join(deleted.select("id"), "id", "left_anti")
    if days is not None:
        kept = since(kept, days, as_of if as_of is not None else F.current_timestamp())
    if newest is not None:
        kept = kept.orderBy(F.desc("analysis_date"), F.desc("id")).limit(newest)
    return kept


def latest_per(history: DataFrame, key: str, keep: int = 1) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.desc("analysis_date"), F.desc("id"))
    return history.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")

"""Android device logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.net import lookup
from logsieve.sources.lines import read_lines

# fixed values: the three line formats and the levels
THREADTIME = r"^(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+([^:]+):\s*(.*)$"
TIME = r"^(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d{3})\s+([VDIWEF])/([^(]+)\(\s*(\d+)\):\s*(.*)$"
BRIEF = r"^([VDIWEF])/([^(]+)\(\s*(\d+)\):\s*(.*)$"
LEVELS = {"V": "debug", "D": "debug", "I": "info", "W": "warning", "E": "error", "F": "critical"}


def logcat_entries(lines: DataFrame, year: int, line: str = "line") -> DataFrame:
    """Lines in one of the three formats; the year is not part of a line and is supplied."""
    c = F.col(line)
    kind = F.when(c.rlike(THREADTIME), "threadtime").when(c.rlike(TIME), "time").when(c.rlike(BRIEF), "brief")
    marked = lines.withColumn("format", kind).where(F.col("format").isNotNull())
    f = F.col("format")

    def part(threadtime: int | None, time: int | None, brief: int | None):
        none = F.lit(None).cast("string")
        return (
            F.when(f == "threadtime", F.regexp_extract(c, THREADTIME, threadtime) if threadtime else none)
            .when(f == "time", F.regexp_extract(c, TIME, time) if time else none)
            .otherwise(F.regexp_extract(c, BRIEF, brief) if brief else none)
        )

    stamp = F.concat(F.lit(f"{year}-"), part(1, 1, None), F.lit(" "), part(2, 2, None))
    return marked.select(
        *[x for x in lines.columns if x != line],
        "format",
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"),
        part(3, 5, 3).try_cast("int").alias("pid"),
        part(4, None, None).try_cast("int").alias("tid"),
        part(5, 3, 1).alias("level"),
        lookup(part(5, 3, 1), LEVELS).alias("severity"),
        F.trim(part(6, 4, 2)).alias("tag"),
        part(7, 6, 4).alias("message"),
    )


def read_logcat(spark: SparkSession, path: str, year: int) -> DataFrame:
    return logcat_entries(read_lines(spark, path), year)

"""Registry exports: key lines, deletions, and values that belong to the key above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.operators.ordered import with_carry
from logsieve.sources.lines import read_lines

KEY = r"^\[(-?)([^\]]+)\]\s*$"
VALUE = r'^("(?:[^"\\]|\\.)*"|@)\s*=\s*(.*)$'
CHUNK_LINES = 10_000


def registry_entries(lines: DataFrame, file: str = "file_id", number: str = "line_no", line: str = "line") -> DataFrame:
    """Keys, deleted keys and values. The key of a value is carried over from chunk to chunk of a file."""
    c = F.trim(line)
    key = F.when(c.rlike(KEY), F.regexp_extract(c, KEY, 2))
    marked = lines.select(
        file, number, c.alias("_c"), key.alias("_key"), F.floor(F.col(number) / CHUNK_LINES).cast("long").alias("_chunk")
    )
    before = W.partitionBy(file).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = with_carry(
        marked, [file], "_chunk", {"_last": F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col(number)))},
        {"_above": F.last("_last", ignorenulls=True).over(before)},
    )
    in_chunk = W.partitionBy(file, "_chunk").orderBy(number)
    current = F.coalesce(F.last("_key", ignorenulls=True).over(in_chunk), F.col("_above"))
    placed = carried.withColumn("key_path", current)
    deleted = F.regexp_extract("_c", KEY, 1) == "-"
    kind = (
        F.when(F.col("_key").isNotNull() & deleted, "registry_delete").when(F.col("_key").isNotNull(), "registry_key")
        .when(F.col("_c").rlike(VALUE) & F.col("key_path").isNotNull(), "registry_value")
    )
    unquoted = lambda v: F.replace(F.regexp_replace(v, r'^"|"$', ""), F.lit("\\\\"), F.lit("\\"))
    data = F.regexp_extract("_c", VALUE, 2)
    value_kind = (
        F.when(data.startswith('"'), "REG_SZ").when(data.rlike("(?i)^dword:"), "REG_DWORD")
        .when(data.rlike(r"(?i)^hex\(2\):"), "REG_EXPAND_SZ").when(data.rlike(r"(?i)^hex\(7\):"), "REG_MULTI_SZ")
        .when(data.rlike("(?i)^hex"), "REG_BINARY").otherwise("unknown")
    )
    is_value = F.col("event_type") == "registry_value"
    return placed.withColumn("event_type", kind).where(F.col("event_type").isNotNull()).select(
        file, number, "event_type", "key_path",
        F.when(is_value, unquoted(F.regexp_extract("_c", VALUE, 1))).alias("value_name"),
        F.when(is_value, unquoted(data)).alias("value_data"),
        F.when(is_value, value_kind).alias("value_type"),
    )


def read_reg_export(spark: SparkSession, path: str) -> DataFrame:
    return registry_entries(read_lines(spark, path))

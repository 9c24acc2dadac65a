"""Text files as numbered lines, without reading any file whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.operators.ordered import with_carry


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, line_no, line). Files are split as usual; a line's number is its place in
    its split plus the lines of the splits before it, so no task sees more than a split."""
    base = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value").alias("line"),
    )
    before = W.partitionBy("file_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = with_carry(
        base, ["file_id"], "_block", {"_n": F.count(F.lit(1))}, {"_offset": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    )
    in_block = W.partitionBy("file_id", "_block").orderBy("_pos")
    return carried.select("file_id", (F.col("_offset") + F.row_number().over(in_block)).alias("line_no"), "line")


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, text) for formats that only make sense as a whole file, such as one JSON array."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))

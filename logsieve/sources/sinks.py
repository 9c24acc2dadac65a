"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dated(df: DataFrame, path: str, ts: str = "ts", fmt: str = "parquet", mode: str = "append") -> None:
    """Append, partitioned by the date of `ts`, so that readers prune by day."""
    dated = df.withColumn("event_date", F.coalesce(F.to_date(ts), F.lit("1970-01-01").cast("date")))
    dated.write.mode(mode).partitionBy("event_date").format(fmt).save(path)


def export_rows(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """JSON lines, or CSV with a header; arrays and maps become text in CSV."""
    if fmt == "csv":
        flat = [
            F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct")) else F.col(name)
            for name, kind in df.dtypes
        ]
        df.select(*flat).write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).json(path)

"""CSV logs: rows as Columns; a folder may hold files of several dialects.

The first lines of every file give its delimiter, columns and their roles, one row per file, found in the executors. The rows of all
files are parsed by the dialect of their own file, and become entries by the roles in it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import net
from logsieve.functions import text as txt
from logsieve.functions.clock import normalize_timestamp
from logsieve.session import cut_lineage

DELIMITERS = (",", "\t", "|", ";", ":")
SAMPLE_LINES = 11
BLANK = "".join(map(chr, range(1, 33)))  # a line of these alone is no row, also where the delimiter is among them
BROADCAST_FILES = 10_000  # dialects of up to so many files are sent to all tasks; more are joined by shuffle
# fixed values: what a header says about its column
ROLES = {
    "timestamp": r"(time|date|timestamp|datetime|created|modified)",
    "source": r"(source|src|host|hostname|computer|device|origin)",
    "ip": r"(ip|address|addr)(?:_|\.)?(?:v4|v6)?",
    "user": r"(user|usr|account|login|username)",
    "message": r"(message|msg|text|description|details|event)",
    "severity": r"(severity|level|priority|type)",
    "action": r"(action|operation|method|command)",
}
MAX_PARTS = 5


def find_delimiter(sample: Sequence[str]) -> str:
    """The candidate that occurs equally often in every sampled line that has it, the most frequent one first."""
    best, best_count = ",", 0
    for candidate in DELIMITERS:
        counts = {line.count(candidate) for line in sample if candidate in line}
        if len(counts) == 1 and (n := counts.pop()) > best_count:
            best, best_count = candidate, n
    return best


def column_roles(columns: Sequence[str]) -> dict[str, list[str]]:
    return {role: [c for c in columns if re.search(p, c, re.IGNORECASE)] for role, p in ROLES.items()}


def _value(name: str) -> Column:
    text = F.trim(F.col(f"`{name}`").cast("string"))
    return F.when(text != "", text)


def _any_timestamp(values: Sequence[Column]) -> Column:
    return F.coalesce(*[F.when(F.length(v) > 8, normalize_timestamp(v)) for v in values]) if values else F.lit(None).cast("timestamp")


def csv_entries(df: DataFrame, roles: dict[str, list[str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a header-named table as entries."""
    columns = [c for c in df.columns if c not in keep and c != "_corrupt_record"]
    roles = roles or column_roles(columns)
    values = {c: _value(c) for c in columns}
    of = lambda role: [values[c] for c in roles.get(role, []) if c in values]
    ips = F.filter(F.array_compact(F.array(*of("ip"))), net.is_ip) if of("ip") else F.array().cast("array<string>")
    source = F.coalesce(*of("source"), F.try_element_at(ips, F.lit(1)), F.lit("csv_file"))
    named = lambda names: [F.when(values[c].isNotNull(), F.concat(F.lit(f"{c}="), values[c])) for c in names]
    first = [c for role in ("action", "user", "ip") for c in roles.get(role, []) if c in values]
    ordered = list(dict.fromkeys([*first, *columns]))
    built = F.array_join(F.slice(F.array_compact(F.array(*named(ordered))), 1, max(MAX_PARTS, len(dict.fromkeys(first)))), " | ")
    given = F.array_join(F.array_compact(F.array(*of("message"))), " | ") if of("message") else F.lit("")
    message = F.when(given != "", given).when(built != "", built).otherwise("CSV row")
    row_text = F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values.values()])
    level = F.coalesce(*of("severity"), F.lit(None).cast("string"))
    action = F.coalesce(*of("action"), F.lit(None).cast("string"))
    users = F.array_distinct(F.array_compact(F.array(*of("user")))) if of("user") else F.array().cast("array<string>")
    pairs = [x for c in columns for x in (F.lit(f"csv_{c}"), values[c])]
    return df.select(
        *keep,
        F.coalesce(_any_timestamp(of("timestamp")), _any_timestamp(list(values.values()))).alias("ts"),
        source.alias("source"),
        txt.guess_event_type(row_text, "csv", action).alias("event_type"),
        txt.severity_from_csv(level, row_text).alias("severity"),
        message.alias("message"),
        users.alias("users"),
        ips.alias("ip_addresses"),
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True) -> DataFrame:
    """All columns as text, with `_corrupt_record` for rows that do not fit; quotes are doubled within quoted values."""
    if delimiter is None:
        sample = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(SAMPLE_LINES).collect()]
        delimiter = find_delimiter(sample)
    plain = spark.read.csv(path, sep=delimiter, header=has_header, inferSchema=False, escape='"')
    schema = ", ".join(f"`{c}` string" for c in plain.columns) + ", _corrupt_record string"
    return spark.read.csv(
        path, sep=delimiter, header=has_header, escape='"', schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )


def _marking(batches):
    """Adds `head`: the place of a line among the first lines of its file that are not blank, else 0.

    A file starts with its first split, which one task reads in order.
    """
    file, seen = None, 0
    for batch in batches:
        heads = np.zeros(batch.num_rows, np.int32)
        starts = batch.column(1).to_numpy() == 0
        for row in np.flatnonzero(starts).tolist():
            name = batch.column(0)[row].as_py()
            if name != file:
                file, seen = name, 0
            elif seen >= SAMPLE_LINES:
                continue
            if seen < SAMPLE_LINES and (batch.column(2)[row].as_py() or "").strip(BLANK):
                seen += 1
                heads[row] = seen
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads)], [*batch.schema.names, "head"])


def _marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, block, line, head); only the first split of a file goes through Python."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    first = text.where("block = 0").mapInArrow(_marking, "file_id string, block long, line string, head int")
    return first.unionByName(text.where("block > 0").withColumn("head", F.lit(0)))


def _unique(names: Sequence[str]) -> list[str]:
    """Header names as Spark gives them: an empty one is its place, one that comes twice has its place added."""
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _dialects(delimiter: str | None, has_header: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sample = rows.sort_values("head")["line"].tolist()
        sep = delimiter or find_delimiter(sample)
        fields = next(csv.reader(sample[:1], delimiter=sep))
        columns = _unique(fields) if has_header else [f"_c{i}" for i in range(len(fields))]
        found = column_roles(columns)
        roles = {role: [columns.index(c) for c in found[role]] for role in ROLES}
        return pd.DataFrame({"file_id": [key[0]], "delimiter": [sep], "columns": [columns], **{f"role_{r}": [places] for r, places in roles.items()}})

    return run


def csv_dialects(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True) -> DataFrame:
    """One row per file that has a line: file_id, delimiter, columns and, by role, the places of its columns."""
    heads = _marked_lines(spark, path).where("head > 0").select("file_id", "head", "line")
    schema = "file_id string, delimiter string, columns array<string>, " + ", ".join(f"role_{r} array<int>" for r in ROLES)
    return heads.groupBy("file_id").applyInPandas(_dialects(delimiter, has_header), schema)


def read_csv_rows(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True) -> DataFrame:
    """Rows of files of any dialects: those of `csv_dialects` with values (as many as columns, null if empty) and corrupt.

    Blank lines and the header of each file are left out. corrupt: the row has more or fewer values than its file has columns. Quotes
    are doubled within quoted values; a value ends with its line.
    """
    dialects = cut_lineage(csv_dialects(spark, path, delimiter, has_header))
    shape = dialects.agg(F.max(F.size("columns")).alias("widest"), F.collect_set("delimiter").alias("separators"), F.count(F.lit(1)).alias("files")).first()
    joined = F.broadcast(dialects) if shape["files"] <= BROADCAST_FILES else dialects
    lines = _marked_lines(spark, path).where(F.btrim("line", F.lit(BLANK)) != "")
    rows = lines.where("head <> 1" if has_header else "true").join(joined, "file_id")
    width = shape["widest"] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    record = F.lit(None).cast(f"struct<{', '.join(f'c{i}: string' for i in range(width))}>")
    for sep in shape["separators"]:
        record = F.when(F.col("delimiter") == sep, F.from_csv("line", F.lit(schema), {"sep": sep, "escape": '"'})).otherwise(record)
    staged = rows.withColumn("_record", record)
    values = F.slice(F.array(*(F.col(f"_record.c{i}") for i in range(width))), F.lit(1), F.size("columns"))
    bare = F.regexp_replace("line", r'"(?:[^"]|"")*"', "")
    found = 1 + F.length(bare) - F.length(F.replace(bare, F.col("delimiter"), F.lit("")))
    return staged.select("file_id", "columns", *(f"role_{r}" for r in ROLES), values.alias("values"), (found != F.size("columns")).alias("corrupt"))


def rows_to_entries(rows: DataFrame, keep: Sequence[str] = ("file_id",)) -> DataFrame:
    """Rows of `read_csv_rows` as entries, each by the roles of its own file; the same as `csv_entries` of a file alone."""
    trimmed = F.transform("values", lambda v: F.when(F.trim(v) != "", F.trim(v)))
    rows = rows.withColumn("_v", trimmed)
    of = lambda role: F.transform(f"role_{role}", lambda i: F.get("_v", i))
    given = lambda array: F.array_compact(array)
    first = lambda array: F.try_element_at(given(array), F.lit(1))
    times = lambda array: F.transform(F.filter(array, lambda v: F.length(v) > 8), normalize_timestamp)
    ips = F.filter(given(of("ip")), net.is_ip)
    lead = F.array_distinct(F.concat("role_action", "role_user", "role_ip"))
    every = F.sequence(F.lit(0), F.size("columns") - 1)
    named = F.transform(F.array_distinct(F.concat(lead, every)), lambda i: F.when(F.get("_v", i).isNotNull(), F.concat(F.get("columns", i), F.lit("="), F.get("_v", i))))
    built = F.array_join(F.slice(given(named), F.lit(1), F.greatest(F.lit(MAX_PARTS), F.size(lead))), " | ")
    told = F.array_join(given(of("message")), " | ")
    row_text = F.array_join(F.transform("_v", lambda v: F.coalesce(v, F.lit(""))), " ")
    metadata = F.map_from_arrays(F.transform("columns", lambda c: F.concat(F.lit("csv_"), c)), F.col("_v"))
    return rows.select(
        *keep,
        F.coalesce(first(times(of("timestamp"))), first(times(F.col("_v")))).alias("ts"),
        F.coalesce(first(of("source")), F.try_element_at(ips, F.lit(1)), F.lit("csv_file")).alias("source"),
        txt.guess_event_type(row_text, "csv", first(of("action"))).alias("event_type"),
        txt.severity_from_csv(first(of("severity")), row_text).alias("severity"),
        F.when(told != "", told).when(built != "", built).otherwise("CSV row").alias("message"),
        F.array_distinct(given(of("user"))).alias("users"),
        ips.alias("ip_addresses"),
        F.map_filter(metadata, lambda k, v: v.isNotNull()).alias("metadata"),
    )


def read_csv_logs(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True) -> DataFrame:
    """Entries of all CSV files under a path, each file by its own delimiter (unless one is given) and header."""
    return rows_to_entries(read_csv_rows(spark, path, delimiter, has_header))

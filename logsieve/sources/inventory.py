"""Which files there are, of what kind, and which are the same."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.net import lookup

# fixed values: kind and category of a file by its extension
KINDS_BY_CATEGORY = {
    "logs": {"log": "generic_log", "syslog": "syslog", "evtx": "windows_event", "evt": "windows_event", "etl": "windows_etl"},
    "network": {"pcap": "pcap", "pcapng": "pcapng", "cap": "pcap", "netflow": "netflow", "zeek": "zeek", "bro": "zeek"},
    "archives": {"zip": "zip", "rar": "rar", "7z": "sevenz", "tar": "tar", "gz": "gzip", "bz2": "bzip2"},
    "documents": {
        "pdf": "pdf", "doc": "doc", "docx": "docx", "xls": "xls", "xlsx": "xlsx", "ppt": "ppt", "pptx": "pptx",
    },
    "email": {"eml": "eml", "msg": "msg", "mbox": "mbox", "pst": "pst", "ost": "ost"},
    "database": {"sqlite": "sqlite", "db": "sqlite", "sql": "sql_dump", "dump": "sql_dump"},
    "structured": {"json": "json", "xml": "xml", "csv": "csv", "yaml": "yaml", "yml": "yaml", "ini": "ini"},
    "forensics": {
        "dd": "disk_image", "img": "disk_image", "e01": "ewf_image", "aff": "aff_image", "vmdk": "vmdk", "vhd": "vhd",
    },
    "code": {
        "py": "python", "js": "javascript", "php": "php", "sh": "shell", "ps1": "powershell", "bat": "batch",
        "exe": "pe_binary", "dll": "pe_binary", "elf": "elf_binary",
    },
    "mobile": {"ab": "android_backup", "logcat": "android_logcat", "ips": "ios_crash"},
}
# fixed values: kind and category by the first bytes of a text file
CONTENT = (
    (r"(?im)^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", "timestamp_log", "logs"),
    (r"(?im)^<\d+>.*\d{4}-\d{2}-\d{2}", "syslog", "logs"),
    (r"(?im)^\[\d{4}-\d{2}-\d{2}", "bracketed_log", "logs"),
    (r"(?im)^\d+\.\d+\.\d+\.\d+\s+-\s+-\s+\[", "apache_access", "logs"),
    (r"(?im)^\[.*?\]\s+\[.*?\]\s+\[.*?\]", "apache_error", "logs"),
    (r"(?im)<Event xmlns=.*microsoft.*>", "windows_event_xml", "logs"),
    (r"(?im)^\s*\{.*\}\s*$", "json", "structured"),
    (r"(?im)^\s*\[.*\]\s*$", "json_array", "structured"),
    (r"(?im)^[^,\n]+,[^,\n]+(,[^,\n]+)*$", "csv", "structured"),
    (r"(?im)^(From|To|Subject|Date|Message-ID):", "email_headers", "email"),
)
HEAD_BYTES = 8192


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind_by_extension(ext: Column) -> tuple[Column, Column]:
    kinds = {e: k for table in KINDS_BY_CATEGORY.values() for e, k in table.items()}
    categories = {e: c for c, table in KINDS_BY_CATEGORY.items() for e in table}
    return lookup(ext, kinds), lookup(ext, categories)


def identify(df: DataFrame, path: str = "path", head: str | None = "head") -> DataFrame:
    """Kind, category, confidence and method: by extension 0.9, by content 0.7, text 0.5, else 0.3."""
    ext = extension(F.col(path))
    by_ext, ext_category = kind_by_extension(F.col("extension"))
    kind = category = F.lit(None).cast("string")
    is_text = F.lit(False)
    if head is not None:
        text = F.substring(head, 1, HEAD_BYTES)
        for pattern, k, c in reversed(CONTENT):
            kind = F.when(text.rlike(pattern), k).otherwise(kind)
            category = F.when(text.rlike(pattern), c).otherwise(category)
        is_text = ~text.rlike(r"[\x00-\x08\x0E-\x1F]")
        kind, category = F.when(is_text, kind), F.when(is_text, category)
    staged = df.withColumn("extension", ext).withColumns({"_kind": kind, "_category": category, "_text": is_text})
    found, content = by_ext.isNotNull(), F.col("_kind").isNotNull()
    return staged.withColumns(
        {
            "kind": F.coalesce(by_ext, F.col("_kind"), F.when(F.col("_text"), "text").otherwise("binary")),
            "category": F.coalesce(ext_category, F.col("_category"), F.lit("generic")),
            "confidence": F.when(found, 0.9).when(content, 0.7).when(F.col("_text"), 0.5).otherwise(0.3),
            "method": F.when(found, "extension").when(content, "content").otherwise("fallback"),
        }
    ).drop("_kind", "_category", "_text")


KNOWN_ENDINGS = r"(?i)\.(" + "|".join(e for table in KINDS_BY_CATEGORY.values() for e in table) + ")$"
RANGED_SCHEMES = ("file", "s3", "s3a", "gs")  # of which executors can read a part of a file


def _heads(batches):
    """The first bytes of each file, by a ranged read."""
    for batch in batches:
        heads = []
        for uri in batch.column(0).to_pylist():
            scheme, rest = uri.split(":", 1)
            if scheme == "file":
                system, path = fs.LocalFileSystem(), "/" + rest.lstrip("/")
            else:
                system, path = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))
            with system.open_input_file(path) as file:
                heads.append(file.read_at(min(HEAD_BYTES, file.size()), 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], [*batch.schema.names, "head"])


def read_inventory(spark: SparkSession, path: str, ranged_schemes: Sequence[str] = RANGED_SCHEMES) -> DataFrame:
    """Files under a path with size and kind.

    Files with a known ending are only listed. Of the others the first HEAD_BYTES are read, whatever their size: by a ranged
    read in the executors where the file system's scheme is one of `ranged_schemes`, else from the whole content, which
    Spark's file source hands out.
    """
    files = spark.read.format("binaryFile").load(path)
    known = F.col("_metadata.file_name").rlike(KNOWN_ENDINGS)
    ranged = F.split_part("path", F.lit(":"), F.lit(1)).isin(*ranged_schemes) if ranged_schemes else F.lit(False)
    listed = ["path", "length", "modificationTime"]
    by_range = files.where(~known & ranged).select(*listed).mapInArrow(_heads, "path string, length long, modificationTime timestamp, head binary")
    whole = files.where(~known & ~ranged).select(*listed, F.substring("content", 1, HEAD_BYTES).alias("head"))
    unknown = by_range.unionByName(whole).withColumn("head", F.decode("head", "ISO-8859-1"))
    return identify(unknown).drop("head").unionByName(identify(files.where(known).select(*listed), head=None))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def normalized_text(text: Column) -> Column:
    """Line endings made one, blanks at line ends dropped."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(unix, r"[ \t]+(?=\n|$)", "")


def text_hash(text: Column) -> Column:
    return F.sha2(normalized_text(text), 256)


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal texts: how many, and the smallest key. Texts travel as hashes only."""
    return (
        df.select(key, text_hash(F.col(text)).alias("hash"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .where(F.col("copies") > 1)
    )


def drop_exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct text, the one with the smallest key."""
    hashed = df.withColumn("hash", text_hash(F.col(text)))
    kept = hashed.groupBy("hash").agg(F.min(key).alias(key)).drop("hash")
    return df.join(kept, key, "left_semi")


def parse_stats(parsed: DataFrame, file: str = "file_id", ok: Column | None = None, ts: str = "ts") -> DataFrame:
    """Per file: rows, parsed and failed rows, rows without a time, and the time covered."""
    good = ok if ok is not None else F.lit(True)
    return parsed.groupBy(file).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("parsed"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"),
        F.count_if(F.col(ts).isNull()).alias("without_time"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )

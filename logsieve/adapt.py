"""The benchmark tables seen as the canonical tables of this library.

Each function is a projection over the given tables, so whatever is asked of it
still prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_EPOCH_SECONDS = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer files than cores; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        "event_type",
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("result"),
        F.col("value").alias("bytes"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of each document, timed one second apart from a per-document start."""
    documents = spread(table(spark, sf_dir, "documents"))
    lines = documents.select(
        F.col("doc_id").alias("file_id"), "source", F.posexplode(F.split("text", "\n")).alias("line_no", "message")
    )
    return lines.select(
        F.concat_ws(":", F.col("file_id").cast("string"), F.col("line_no").cast("string")).alias("entry_id"),
        "file_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.timestamp_seconds(F.lit(ENTRY_EPOCH_SECONDS) + F.col("file_id") * 37 + F.col("line_no")).alias("ts"),
        "source",
        "message",
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("flow_id"),
        F.col("o_custkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
        F.col("l_partkey").alias("dst_port"),
        F.col("l_extendedprice").cast("double").alias("bytes"),
        F.col("l_quantity").cast("double").alias("packets"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    )


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("dst"), F.col("n_name").alias("country")
    )
    return flows(spark, sf_dir).join(places, "dst").select(
        F.col("src").alias("user"), "country", "ts", "l_orderkey", "l_linenumber"
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id"
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))


SEVERITY_BANDS = ((75, "critical"), (50, "high"), (25, "medium"))


def severity_band(score):
    band = F.lit("low")
    for bound, name in reversed(SEVERITY_BANDS):
        band = F.when(score >= bound, name).otherwise(band)
    return band


# fixed values: attack techniques given to the stand-in history rows, by doc_id % 15
HISTORY_TECHNIQUES = ("T1110", "T1059", "T1071", "T1046", "T1486")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    score = (F.col("doc_id") % 101).cast("int")
    known = F.array(*[F.lit(t) for t in HISTORY_TECHNIQUES])
    picks = F.slice(known, 1, (F.col("doc_id") % 15 % 6).cast("int"))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit(".log")).alias("file_name"),
        F.col("source").alias("file_type"),
        F.col("n_chars").cast("long").alias("file_size"),
        F.sha2("text", 256).alias("file_hash"),
        F.timestamp_seconds(F.lit(ENTRY_EPOCH_SECONDS) + (F.col("doc_id") % 60) * 86400 + F.col("doc_id") % 86400).alias(
            "analysis_date"
        ),
        score.alias("threat_score"),
        severity_band(score).alias("severity"),
        (F.col("doc_id") % 7).cast("int").alias("iocs_found"),
        picks.alias("mitre_techniques"),
        F.array(F.col("lang")).alias("tags"),
        F.lit("").alias("notes"),
    )


# fixed values: message shapes of the stand-in log lines, chosen by k % 20
MESSAGE_TEMPLATES = (
    "Failed login for user_{u} from {priv} port 22",
    "Accepted login for user_{u} from {pub}; session success",
    "Permission denied: user_{u} reading /etc/shadow",
    "GET /index.php?id=1 union select name from users HTTP/1.1 from {pub}",
    "GET /../../etc/passwd HTTP/1.1 src: {pub} dst: {priv} port: {k}",
    "powershell.exe -c Invoke-Expression payload {k}",
    "whoami executed by user_{u} on host-{k}",
    "net view run by admin on {priv}",
    "critical: disk failure on node {k}",
    "warning: timeout connecting to c2.evil.com beacon interval {k}",
    "info: nightly backup archive.zip compressed by rsync *",
    "src {priv} dst {pub} port {k} outbound connect",
    "download http://malware-delivery.net:8080/shell.php?x={k} hash d41d8cd98f00b204e9800998ecf8427e",
    "file C:\\Windows\\Temp\\run{k}.exe written md5 {md5} by user_{u}",
    "registry HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run set by user_{u}",
    "mimikatz lsass credential dump attempt CVE-2021-44228; cat /etc/passwd",
    "session 550e8400-e29b-41d4-a716-4466554400{k2} closed 2024-01-02T03:04:05",
    "service stop: shutdown of unit-{k} by root",
    "email from user{u}@mail.example.org to ops@paypal-secure.tk verify your account",
    "heartbeat ok {k} from 192.168.1.{k}",
)


def _fill(templates, slot, parts: dict):
    """The chosen template with its named places filled in."""
    out = F.element_at(F.array(*[F.lit(t) for t in templates]), slot + 1)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with security wording, one per event."""
    events = spread(table(spark, sf_dir, "events")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, k = F.col("user_id").cast("string"), F.col("k").cast("string")
    parts = {
        "u": user,
        "k": k,
        "k2": F.lpad(k, 2, "0"),
        "md5": F.md5(user),
        "priv": F.concat(
            F.lit("10.0."), (F.col("k") % 4).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string")
        ),
        "pub": F.concat(F.lit("203.0.113."), k),
    }
    text = _fill(MESSAGE_TEMPLATES, F.col("k") % 20, parts)
    return events.select(
        F.col("event_id").cast("string").alias("entry_id"),
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("host-"), (F.col("user_id") % 16).cast("string")).alias("source"),
        F.concat(F.lit("user_"), user).alias("user"),
        "event_type",
        "k",
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        text.alias("message"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, document lines, addresses and sources of pages together."""

    def named(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    def pages(prefix: str, column: str):
        return table(spark, sf_dir, "pages").select(
            named(prefix, "page_id").alias("entry_id"), named("page-", "page_id").alias("file_id"), F.col(column).alias("message")
        )

    lines = entries(spark, sf_dir).select("entry_id", named("document-", "file_id").alias("file_id"), "message")
    logged = messages(spark, sf_dir).select("entry_id", named("user-", "file_id").alias("file_id"), "message")
    return logged.union(pages("p", "url")).union(pages("h", "html")).union(lines)

"""Detectors that count distinct partners of a key, and row filters over hosts.

Distinct counts are Spark's two-step distinct aggregation: (key, value) pairs are
deduplicated before the shuffle on the key, so a heavy key arrives as its distinct
values only. Samples of values are cut by rank, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.net import lookup
from logsieve.functions.rows import explode_computed
from logsieve.operators.stats import entropy_of_counts, stat_outliers

# fixed values
STANDARD_PORTS = {80: "HTTP", 443: "HTTPS", 22: "SSH", 21: "FTP", 25: "SMTP", 53: "DNS", 3389: "RDP", 3306: "MySQL"}
LIVING_OFF_THE_LAND = (
    "powershell", "cmd", "wscript", "cscript", "rundll32", "regsvr32", "mshta", "bitsadmin", "certutil",
)
SENSITIVE_PATHS = (
    "system32", "temp", "appdata", "programdata", ".ssh", ".aws", ".config", "passwords", "credentials",
)
FILE_CHANGES = ("write", "delete", "modify")
SENSITIVE_KEYS = ("run", "runonce", "services", "drivers", "winlogon", "userinit", "shell", "startup")
KEY_CHANGES = ("create", "modify", "delete")


def first_values(df: DataFrame, keys: Sequence[str], value: str, limit: int, name: str) -> DataFrame:
    """The `limit` smallest distinct values of each key, as a sorted array."""
    keys = list(keys)
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    ranked = distinct.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(value))).where(F.col("_r") <= limit)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def present(*columns: str) -> Column:
    """Set and neither empty nor zero."""
    cond = F.lit(True)
    for c in columns:
        text = F.col(c).cast("string")
        cond = cond & text.isNotNull() & ~text.isin("", "0")
    return cond


def distinct_over(
    df: DataFrame, keys: Sequence[str], value: str, over: int, name: str = "distinct_values", total: str = "events"
) -> DataFrame:
    """Keys with more than `over` distinct values."""
    return (
        df.groupBy(*keys)
        .agg(F.count_distinct(value).alias(name), F.count(F.lit(1)).alias(total))
        .where(F.col(name) > over)
    )


def user_action_entropy(df: DataFrame, user: str = "user", action: str = "action", over: float = 3.0) -> DataFrame:
    spread = entropy_of_counts(df.where(present(user)), [user], action)
    return spread.where(F.col("entropy") > over).select(
        user, F.col("distinct_values").alias("action_count"), F.col("entropy").alias("action_entropy"),
        F.col("total").alias("total_actions"),
    )


def multi_source_users(df: DataFrame, user: str = "user", source: str = "source", over: int = 5) -> DataFrame:
    return distinct_over(df.where(present(user)), [user], source, over, "sources", "events")


def sources_of_users(df: DataFrame, users: DataFrame, user: str = "user", source: str = "source") -> DataFrame:
    """All sources of the reported users, one row each."""
    return df.select(user, source).distinct().join(users.select(user), user, "left_semi")


def unusual_hours(df: DataFrame, user: str = "user", ts: str = "ts", first: int = 1, last: int = 5) -> DataFrame:
    """Users active at night: events per hour of the night, as a fixed set of 24 counters at most."""
    at_night = df.where(present(user) & F.hour(ts).between(first, last))
    hours = range(first, last + 1)
    return at_night.groupBy(user).agg(
        F.count(F.lit(1)).alias("events"),
        F.array_compact(
            F.array(*[F.when(F.count_if(F.hour(ts) == h) > 0, F.lit(h)) for h in hours])
        ).alias("hours"),
    )


def port_scan(
    df: DataFrame, keys: Sequence[str] = ("src", "dst"), port: str = "dst_port", over: int = 20, sample: int = 50
) -> DataFrame:
    """Pairs with many distinct ports, with the lowest ports as a sample."""
    keys = list(keys)
    seen = df.where(present(*keys, port)).select(*keys, port).distinct()
    ranked = seen.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(port))).where(F.col("_r") <= sample)
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("ports")).where(F.col("ports") > over)
    samples = ranked.join(counts, keys, "left_semi").groupBy(*keys).agg(
        F.array_sort(F.collect_list(port)).alias("sample_ports")
    )
    return counts.join(samples, keys)


def distributed_scan(
    df: DataFrame, src: str = "src", dst: str = "dst", port: str = "dst_port", targets: int = 10, ports: int = 100
) -> DataFrame:
    return (
        df.where(present(src, dst, port))
        .groupBy(src)
        .agg(F.count_distinct(dst).alias("targets"), F.count_distinct(port).alias("ports"))
        .where((F.col("targets") > targets) & (F.col("ports") > ports))
    )


def protocol_mismatch(
    df: DataFrame, port: str = "dst_port", protocol: str = "protocol", standard: dict[int, str] | None = None
) -> DataFrame:
    """Rows whose protocol is neither TCP nor the usual one of the port."""
    expected = lookup(F.col(port).cast("int"), standard or STANDARD_PORTS)
    shown = df.withColumn("expected_protocol", expected)
    actual = F.upper(protocol)
    return shown.where(
        present(port, protocol) & F.col("expected_protocol").isNotNull()
        & (actual != F.upper("expected_protocol")) & (actual != "TCP")
    )


def connection_fanout(df: DataFrame, src: str = "src", dst: str = "dst", over: int = 50) -> DataFrame:
    return distinct_over(df.where(present(src, dst)), [src], dst, over, "destinations", "connections")


def multi_geo(df: DataFrame, user: str = "user", country: str = "country", over: int = 3) -> DataFrame:
    return distinct_over(df.where(present(user, country)), [user], country, over, "countries", "events")


def impossible_travel(
    df: DataFrame,
    user: str = "user",
    country: str = "country",
    ts: str = "ts",
    order_by: Sequence[str] = ("ts",),
    within_seconds: float = 7200,
    segment_seconds: int = 86_400,
) -> DataFrame:
    """Consecutive events of a user in two countries closer than two hours."""
    from logsieve.operators.ordered import MICROS, micros, previous_row

    paired = previous_row(df.where(present(user, country)), [user], order_by, [country, ts], ts, segment_seconds)
    gap = (micros(ts) - micros(f"prev_{ts}")) / F.lit(float(MICROS))
    return paired.where((F.col(country) != F.col(f"prev_{country}")) & (gap < within_seconds)).withColumn("gap_seconds", gap)


def out_degree(df: DataFrame, src: str = "src", dst: str = "dst", over: int = 5) -> DataFrame:
    return distinct_over(df.where(present(src, dst)), [src], dst, over, "targets", "connections").withColumn(
        "confidence", F.least(F.col("targets") / 10, F.lit(0.9))
    )


def ports_per_ip(df: DataFrame, ip: str = "ip", port: str = "port", over: int = 20) -> DataFrame:
    return distinct_over(df, [ip], port, over, "ports", "events").withColumn(
        "confidence", F.least(F.col("ports") / 50, F.lit(0.95))
    )


def resource_outliers(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows that are outliers of a gauge and above its limit, per gauge."""
    found = None
    for gauge, limit in limits.items():
        one = stat_outliers(df, gauge).where(F.col(gauge) > limit)
        one = one.select(*df.columns, F.lit(gauge).alias("resource"), F.col(gauge).cast("double").alias("reading"))
        found = one if found is None else found.unionByName(one)
    return found


def suspicious_process(df: DataFrame, process: str = "process_name", names: Sequence[str] = LIVING_OFF_THE_LAND):
    """One row per name found in a process name."""
    known = F.array(*[F.lit(n) for n in names])
    hits = F.filter(known, lambda n: F.contains(F.lower(process), n))
    return explode_computed(df, df.columns, hits, "matched_name")


def process_parents(df: DataFrame, process: str = "process_name", parent: str = "parent_process", over: int = 5):
    return distinct_over(
        df.withColumn("process", F.lower(process)), ["process"], parent, over, "parent_count", "starts"
    )


def _sensitive_change(df, text, words, operation, changes):
    known = F.array(*[F.lit(w) for w in words])
    hits = F.filter(known, lambda w: F.contains(F.lower(text), w))
    return explode_computed(df.where(F.col(operation).isin(*changes)), df.columns, hits, "matched_word")


def suspicious_file_op(df: DataFrame, path: str = "file_path", operation: str = "operation") -> DataFrame:
    return _sensitive_change(df, path, SENSITIVE_PATHS, operation, FILE_CHANGES)


def registry_modification(df: DataFrame, key: str = "registry_key", operation: str = "operation") -> DataFrame:
    return _sensitive_change(df, key, SENSITIVE_KEYS, operation, KEY_CHANGES)


def mass_file_op(df: DataFrame, path: str = "file_path", operation: str = "operation", over: int = 100) -> DataFrame:
    """Paths with many operations, and the count of each kind of operation."""
    per_op = df.groupBy(F.lower(path).alias("path"), operation).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_op.groupBy("path")
        .agg(
            F.sum("n").alias("operation_count"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(operation), "n")))).alias("operations"),
        )
        .where(F.col("operation_count") > over)
    )


def rare_patterns(df: DataFrame, pattern: Column, examples: str, share: float = 0.001, keep: int = 3) -> DataFrame:
    """Patterns seen at most max(1, 0.1 %) of all rows, with up to three examples."""
    from logsieve.operators.stats import with_scalars

    marked = df.withColumn("pattern", pattern)
    counts = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("occurrences"), F.min(examples).alias("first_example"))
    total = counts.agg(F.sum("occurrences").alias("total"))
    rare = with_scalars(counts, total).where(
        F.col("occurrences") <= F.greatest(F.lit(1.0), F.col("total") * share)
    )
    return rare.select("pattern", "occurrences", (F.col("occurrences") / F.col("total")).alias("frequency"), "first_example")


def examples_of(df: DataFrame, pattern: Column, rare: DataFrame, example: str, keep: int = 3) -> DataFrame:
    """Up to `keep` examples of each reported pattern."""
    rows = df.select(pattern.alias("pattern"), example).join(rare.select("pattern"), "pattern", "left_semi")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("pattern").orderBy(example))).where(F.col("_r") <= keep)
    return ranked.groupBy("pattern").agg(F.array_sort(F.collect_list(example)).alias("examples"))

"""Detections over Android device logs (see sources.logcat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.functions.text import contains_any
from logsieve.operators.stats import with_scalars

# fixed values: patterns by category, tested in this order
PATTERNS = {
    "malware_indicators": (
        r"dex2oat.*failed", r"Permission denied.*\/(system|data)", r"SELinux.*denied", r"INJECT_EVENTS",
        r"android\.permission\..*denied", r"Exploit.*detected", r"Root.*detected", r"su\s+binary", r"magisk|supersu|kingroot",
    ),
    "privacy_violations": (
        r"accessing.*contacts.*without permission", r"accessing.*location.*without permission",
        r"accessing.*camera.*without permission", r"accessing.*microphone.*without permission",
        r"reading.*SMS.*without permission", r"clipboard.*accessed", r"screenshot.*captured",
    ),
    "network_suspicious": (
        r"connecting to.*(\d{1,3}\.){3}\d{1,3}", r"SSL.*certificate.*invalid", r"HTTP.*plaintext", r"DNS.*spoofing",
        r"MITM.*detected", r"Proxy.*detected", r"VPN.*connection",
    ),
    "system_compromise": (
        r"bootloader.*unlocked", r"dm-verity.*disabled", r"SELinux.*permissive", r"debuggerd.*crash", r"tombstone.*written",
        r"native.*crash", r"SIGSEGV|SIGBUS|SIGILL",
    ),
    "app_suspicious": (
        r"overlay.*detected", r"accessibility.*abuse", r"admin.*privileges.*requested", r"factory.*reset",
        r"package.*installed.*unknown.*source", r"adb.*install", r"pm\s+install",
    ),
}
CRITICAL_CATEGORIES = ("malware_indicators", "system_compromise")
ROOT_WORDS = ("root", "su", "magisk")


def is_crash(message: Column) -> Column:
    return contains_any(F.lower(message), ("crash", "fatal"))


def is_denial(message: Column) -> Column:
    return contains_any(F.lower(message), ("permission denied", "not granted"))


def process_profile(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages, tags and time covered per process; with a limit the busiest ones, in order."""
    per = df.groupBy("pid").agg(
        F.count(F.lit(1)).alias("message_count"), F.count_distinct("tag").alias("tags"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).withColumn("duration_seconds", (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6)
    return per.orderBy(F.desc("message_count"), "pid").limit(limit) if limit is not None else per


def pattern_alerts(df: DataFrame, keep: tuple[str, ...], message: str = "message") -> DataFrame:
    """One row per category found in a message, with its first pattern."""
    m = F.col(message)
    parts = []
    for category, patterns in PATTERNS.items():
        first = F.coalesce(*[F.when(m.rlike(f"(?i){p}"), F.lit(p)) for p in patterns])
        severity = "critical" if category in CRITICAL_CATEGORIES else "warning"
        parts.append(
            F.when(
                first.isNotNull(),
                F.struct(F.lit(category).alias("category"), first.alias("pattern"), F.lit(severity).alias("severity")),
            )
        )
    found = explode_computed(df, [*keep, m.alias("_m")], F.array_compact(F.array(*parts)), "_a")
    rooted = (F.col("_a.category") == "malware_indicators") & contains_any(F.lower("_m"), ROOT_WORDS)
    return found.select(*keep, "_a.*", rooted.alias("rooted_device"))


def crash_patterns(df: DataFrame, over_all: int = 10, per_tag: int = 5) -> DataFrame:
    counts = df.where(is_crash(F.col("message"))).groupBy("tag").agg(F.count(F.lit(1)).alias("crashes"))
    total = counts.agg(F.coalesce(F.sum("crashes"), F.lit(0)).alias("all_crashes"))
    return with_scalars(counts, total).where((F.col("all_crashes") > over_all) & (F.col("crashes") >= per_tag))


def denial_abuse(df: DataFrame, over_all: int = 20, per_process: int = 10) -> DataFrame:
    counts = df.where(is_denial(F.col("message"))).groupBy("pid").agg(F.count(F.lit(1)).alias("denials"))
    total = counts.agg(F.coalesce(F.sum("denials"), F.lit(0)).alias("all_denials"))
    return with_scalars(counts, total).where((F.col("all_denials") > over_all) & (F.col("denials") >= per_process))


def installs(df: DataFrame) -> DataFrame:
    return df.where((F.col("tag") == "PackageManager") & contains_any(F.lower("message"), ("install", "added")))


# fixed values: names of harmful packages
BAD_PACKAGES = (
    "com.malware", "com.spyware", "com.trojan", "com.android.system.update", "com.google.service", "com.whatsapp.update",
    "com.android.systemui.overlay",
)


def bad_packages(df: DataFrame, packages: tuple[str, ...] = BAD_PACKAGES) -> DataFrame:
    """Install messages that name a harmful package, one row per package."""
    named = F.filter(F.array(*[F.lit(p) for p in packages]), lambda p: F.contains(F.col("message"), p))
    return explode_computed(installs(df), df.columns, named, "package")


def device_summary(df: DataFrame, keep: tuple[str, ...] = ("pid",)) -> DataFrame:
    """One row: alerts by category and the risks they stand for."""
    alerts = pattern_alerts(df, keep)
    counts = alerts.agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in PATTERNS], F.count_if("rooted_device").alias("_rooted")
    )
    others = df.agg(F.count_if(is_crash(F.col("message"))).alias("crashes"), F.count_if(is_denial(F.col("message"))).alias("denials"))
    both = with_scalars(counts, others)
    risks = F.array_compact(
        F.array(
            F.when(F.col("_rooted") > 0, F.lit("Device appears to be rooted")),
            F.when(F.col("malware_indicators") > 0, F.lit("Malware indicators detected")),
            F.when(F.col("denials") > 50, F.lit("Excessive permission denial activity")),
            F.when(F.col("privacy_violations") > 0, F.lit("Privacy violations detected")),
            F.when(F.col("crashes") > 20, F.lit("System instability - multiple crashes")),
        )
    )
    return both.withColumn("risks", risks).drop("_rooted")

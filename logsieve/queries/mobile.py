"""Device log detections over lines made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import device
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

MESSAGES = (
    "SELinux: avc denied for app", "magisk su binary found", "accessing contacts without permission", "clipboard was accessed", "connecting to 10.2.3.4 now",
    "SSL certificate is invalid", "bootloader is unlocked", "native heap crash SIGSEGV", "overlay window detected", "pm install of com.malware.app", "all fine",
    "FATAL exception crash in app", "Permission denied: camera", "Package com.whatsapp.update added",
)


def entries(spark, sf_dir):
    k = F.col("k")
    base = adapt.messages(spark, sf_dir)
    return base.select(
        "entry_id", "ts", (F.col("file_id") % 40).alias("pid"), F.when(k % 14 == 13, "PackageManager").when(k % 14 == 9, "PackageManager").otherwise(F.concat(F.lit("Tag"), (k % 6).cast("string"))).alias("tag"),
        F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), k % len(MESSAGES) + 1).alias("message"),
    )


DEVICE_SQL = f""", de AS (SELECT entry_id, us, file_id % 40 AS pid, CASE WHEN k % 14 IN (9, 13) THEN 'PackageManager' ELSE 'Tag' || (k % 6) END AS tag,
    [{', '.join(s.text(m) for m in MESSAGES)}][k % {len(MESSAGES)} + 1] AS message FROM messages)"""


PROFILE_SQL = DEVICE_SQL + """ SELECT pid, count(*) AS message_count, count(DISTINCT tag) AS tags, round((max(us) - min(us)) / 1e6, 6) AS duration_seconds FROM de GROUP BY 1"""


@query("device_process_profile", s.with_ctes("messages", PROFILE_SQL))
def device_process_profile(spark, sf_dir):
    return rounded(device.process_profile(entries(spark, sf_dir)).drop("first_ts", "last_ts"))


@query("device_busiest_processes", s.with_ctes("messages", PROFILE_SQL + " ORDER BY message_count DESC, pid LIMIT 10"))
def device_busiest_processes(spark, sf_dir):
    return rounded(device.process_profile(entries(spark, sf_dir), limit=10).drop("first_ts", "last_ts"))


def _category_sql(name, patterns):
    first = "CASE " + " ".join(f"WHEN regexp_matches(message, {s.text('(?i)' + p)}) THEN {s.text(p)}" for p in patterns) + " END"
    level = "critical" if name in device.CRITICAL_CATEGORIES else "warning"
    rooted = s.has_any("lower(message)", device.ROOT_WORDS) if name == "malware_indicators" else "false"
    return f"SELECT entry_id, '{name}' AS category, {first} AS pattern, '{level}' AS severity, {rooted} AS rooted_device FROM de"


ALERT_SQL = DEVICE_SQL + ", al AS (SELECT * FROM (" + " UNION ALL ".join(_category_sql(n, p) for n, p in device.PATTERNS.items()) + ") WHERE pattern IS NOT NULL)"


@query("device_pattern_alerts", s.with_ctes("messages", ALERT_SQL + " SELECT * FROM al"))
def device_pattern_alerts(spark, sf_dir):
    return device.pattern_alerts(entries(spark, sf_dir), ("entry_id",))


CRASH = "(contains(lower(message), 'crash') OR contains(lower(message), 'fatal'))"
DENIED = "(contains(lower(message), 'permission denied') OR contains(lower(message), 'not granted'))"


@query(
    "device_crash_patterns",
    s.with_ctes("messages", DEVICE_SQL + f" SELECT tag, count(*) AS crashes, (SELECT count(*) FROM de WHERE {CRASH}) AS all_crashes FROM de WHERE {CRASH} GROUP BY 1 HAVING count(*) >= 5"),
)
def device_crash_patterns(spark, sf_dir):
    return device.crash_patterns(entries(spark, sf_dir))


@query(
    "device_denial_abuse",
    s.with_ctes("messages", DEVICE_SQL + f" SELECT pid, count(*) AS denials, (SELECT count(*) FROM de WHERE {DENIED}) AS all_denials FROM de WHERE {DENIED} GROUP BY 1 HAVING count(*) >= 10"),
)
def device_denial_abuse(spark, sf_dir):
    return device.denial_abuse(entries(spark, sf_dir))


@query(
    "device_installs",
    s.with_ctes("messages", DEVICE_SQL + " SELECT entry_id, message FROM de WHERE tag = 'PackageManager' AND (contains(lower(message), 'install') OR contains(lower(message), 'added'))"),
)
def device_installs(spark, sf_dir):
    return device.installs(entries(spark, sf_dir)).select("entry_id", "message")


@query(
    "device_bad_packages",
    s.with_ctes("messages", DEVICE_SQL + f", b AS {s.values([[p] for p in device.BAD_PACKAGES], 'package')} SELECT entry_id, package FROM de JOIN b ON contains(message, package) WHERE tag = 'PackageManager'"),
)
def device_bad_packages(spark, sf_dir):
    return device.bad_packages(entries(spark, sf_dir)).select("entry_id", "package")


@query(
    "device_summary",
    s.with_ctes(
        "messages",
        ALERT_SQL + " SELECT " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in device.PATTERNS)
        + f""", (SELECT count(*) FROM de WHERE {CRASH}) AS crashes, (SELECT count(*) FROM de WHERE {DENIED}) AS denials,
        'Device appears to be rooted|Malware indicators detected|Excessive permission denial activity|Privacy violations detected|System instability - multiple crashes' AS risks FROM al""",
    ),
)
def device_summary(spark, sf_dir):
    return device.device_summary(entries(spark, sf_dir)).withColumn("risks", F.array_join("risks", "|"))

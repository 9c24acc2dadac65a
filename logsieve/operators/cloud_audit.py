"""Detections and reports over cloud audit calls (see sources.cloud)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.operators.ordered import MICROS, range_profile
from logsieve.operators.stats import with_scalars
from logsieve.sources.cloud import HIGH_RISK_CALLS

# fixed values
ENUMERATION = r"^(List|Describe|Get)"
PERMISSION_CALLS = (
    "AttachUserPolicy", "PutUserPolicy", "AttachRolePolicy", "PutRolePolicy", "CreateAccessKey", "CreateLoginProfile",
)
EVASION_CALLS = ("StopLogging", "DeleteTrail", "DeleteLogGroup", "DeleteAlarms", "DisableAlarmActions")


def enumeration(calls: DataFrame, min_calls: int = 10, within_seconds: float = 300) -> DataFrame:
    """Users with many listing calls from first to last within five minutes."""
    per_user = calls.where(F.col("event_name").rlike(ENUMERATION)).groupBy("user").agg(
        F.count(F.lit(1)).alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct("event_name").alias("distinct_calls"),
    )
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(float(MICROS))
    return per_user.withColumn("span_seconds", span).where((F.col("calls") >= min_calls) & (span < within_seconds))


def permission_changes(calls: DataFrame, min_calls: int = 3) -> DataFrame:
    per_user = calls.where(F.col("event_name").isin(*PERMISSION_CALLS)).groupBy("user").agg(
        F.count(F.lit(1)).alias("changes"), F.array_sort(F.collect_set("event_name")).alias("actions"), F.min("ts").alias("first_ts")
    )
    return per_user.where(F.col("changes") >= min_calls).withColumn("severity", F.lit("critical"))


def logging_disabled(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("event_name").isin(*EVASION_CALLS)).groupBy("user").agg(
        F.count(F.lit(1)).alias("calls"), F.array_sort(F.collect_set("event_name")).alias("actions"), F.min("ts").alias("first_ts")
    )


def rapid_calls(
    calls: DataFrame, call_id: str = "event_id", key: str = "user", ts: str = "ts", burst: int = 10, within_seconds: float = 10,
    segment_seconds: int = 3600,
) -> DataFrame:
    """First time a user makes ten calls in less than ten seconds."""
    # ten calls from t on in less than w seconds: at least ten calls in [t, t + w - 1 microsecond]
    found = range_profile(
        calls, [key], F.lit(True), [call_id], {"calls": F.lit(1.0)}, after_seconds=within_seconds - 1 / MICROS, include_start=True,
        ts=ts, segment_seconds=segment_seconds,
    ).where(F.col("calls") >= burst)
    return found.groupBy(key).agg(F.min(F.struct("anchor_us", call_id)).alias("_f")).select(
        key, F.col("_f.anchor_us").alias("first_us"), F.col(f"_f.{call_id}").alias(call_id)
    )


def same_calls_from_many(
    calls: DataFrame, ip: str = "source_ip", ts: str = "ts", tie: str = "event_id", over_calls: int = 5, first: int = 10, min_ips: int = 5
) -> DataFrame:
    """Sets of first calls that at least five addresses share."""
    busy = calls.groupBy(ip).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > over_calls)
    order = W.partitionBy(ip).orderBy(ts, tie)
    early = calls.select(ip, ts, tie, "event_name").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first)
    signatures = early.join(busy, ip, "left_semi").groupBy(ip).agg(
        F.array_join(F.array_sort(F.collect_set("event_name")), ",").alias("pattern")
    )
    return signatures.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("ip_count"), F.min(ip).alias("first_ip")
    ).where(F.col("ip_count") >= min_ips)


def high_risk_alerts(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("event_name").isin(*HIGH_RISK_CALLS))


def risk_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HIGH_RISK_CALLS.items()), "event_name string, risk string")


def top_users(calls: DataFrame, limit: int = 10) -> DataFrame:
    return (
        calls.groupBy("user")
        .agg(
            F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("error_code") != "").alias("error_events"),
            F.count_if(F.col("event_name").isin(*HIGH_RISK_CALLS)).alias("high_risk_events"),
            F.count_distinct("source_ip").alias("unique_ips"),
        )
        .orderBy(F.desc("total_events"), "user").limit(limit)
    )


def top_calls(calls: DataFrame, limit: int = 20) -> DataFrame:
    counts = calls.groupBy("event_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_name").limit(limit)
    return counts.join(risk_catalogue(calls.sparkSession), "event_name", "left").withColumns(
        {"risk_level": F.when(F.col("risk").isNotNull(), "high").otherwise("normal"), "risk": F.coalesce("risk", F.lit(""))}
    )


def risk_summary(calls: DataFrame, many_ips: int = 50) -> DataFrame:
    totals = calls.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_name").isin(*HIGH_RISK_CALLS)).alias("_risk"),
        F.count_if(F.col("error_code") != "").alias("_errors"),
        F.count_distinct(F.when(F.col("error_code") != "", F.col("user"))).alias("users_with_errors"),
        F.count_if(F.col("event_name") == "StopLogging").alias("_stop"),
        F.count_if(F.col("event_name") == "CreateAccessKey").alias("_keys"),
        F.count_if(F.col("event_name").isin(*EVASION_CALLS)).alias("_evasion"),
        F.count_distinct("source_ip").alias("_ips"),
    )
    escalating = permission_changes(calls).agg(F.count(F.lit(1)).alias("_escalating"))
    both = with_scalars(totals, escalating)
    base = F.greatest(F.col("total_events"), F.lit(1))
    risks = F.array_compact(
        F.array(
            F.when(F.col("_stop") > 0, F.lit("Audit logging disabled")), F.when(F.col("_keys") > 0, F.lit("New access keys created")),
            F.when(F.col("_escalating") > 0, F.lit("Privilege escalation attempts")),
            F.when(F.col("_evasion") > 0, F.lit("Defense evasion detected")),
            F.when(F.col("_ips") > many_ips, F.lit("Activity from many different IPs")),
        )
    )
    return both.select(
        "total_events", (F.col("_risk") / base * 100).alias("high_risk_percentage"), (F.col("_errors") / base * 100).alias("error_rate"),
        "users_with_errors", risks.alias("top_risks"),
    )


def calls_by_region(calls: DataFrame) -> DataFrame:
    return calls.groupBy("region").agg(F.count(F.lit(1)).alias("calls"))

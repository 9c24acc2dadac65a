"""A whole analysis as one lazily built plan: entries in, findings, techniques and scores out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import is_error
from logsieve.operators import attack, buckets, fanout, findings, ioc, pattern, sigma, signatures, timing
from logsieve.plans import report


def anomalies(events: DataFrame, ts: str = "ts", user: str = "user", source: str = "source") -> DataFrame:
    """Findings of the log detectors in their common shape."""
    errors = buckets.error_rate_spikes(events, is_error(F.col("level"), F.col("message")), ts)
    volumes = buckets.volume_anomalies(events, ts)
    rapid = timing.rapid_fire(events, source, ts)
    hours = fanout.unusual_hours(events, user, ts)
    parts = [
        findings.to_findings(
            errors, "error_rate_spike", F.col("severity"), 0.85, F.col("bucket"), {"rate": F.col("error_rate")}, ts=F.col("bucket")
        ),
        findings.to_findings(
            volumes, "volume_anomaly", F.col("severity"), 0.9, F.col("bucket"), {"events": F.col("events")}, ts=F.col("bucket")
        ),
        findings.to_findings(rapid, "rapid_fire_events", "high", 0.95, F.col(source), {"min_gap": F.col("min_gap")}),
        findings.to_findings(hours, "unusual_activity_time", "medium", 0.7, F.col(user), {"events": F.col("events")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_results(
    entries: DataFrame, sigma_rules: Sequence[sigma.SigmaRule], signature_rules: Sequence[signatures.SignatureRule]
) -> DataFrame:
    """(file_id, kind, name, level, technique, confidence) of rules, signatures and behaviour patterns, per file."""
    spark = entries.sparkSession
    catalogue = sigma.rules_table(spark, sigma_rules)
    rules = (
        sigma.sigma_match(entries, sigma_rules, keep=["file_id"]).groupBy("file_id", "rule_id").agg(F.max("confidence").alias("confidence"))
        .join(catalogue, "rule_id")
        .select("file_id", F.lit("sigma").alias("kind"), F.col("title").alias("name"), "level", F.lit("").alias("technique"), "confidence")
    )
    marks = (
        signatures.signature_match(entries, signature_rules, keep=["file_id"])
        .groupBy("file_id", "rule", "severity", "mitre_technique").agg(F.max("confidence").alias("confidence"))
        .select("file_id", F.lit("signature").alias("kind"), F.col("rule").alias("name"), F.col("severity").alias("level"), F.col("mitre_technique").alias("technique"), "confidence")
    )
    found = (
        pattern.behaviour_tags(entries, keep=["file_id"]).distinct()
        .select("file_id", F.lit("pattern").alias("kind"), F.col("behaviour").alias("name"), F.lit("medium").alias("level"), F.lit("").alias("technique"), F.lit(0.8).alias("confidence"))
    )
    return rules.unionByName(marks).unionByName(found)


def analyze(
    entries: DataFrame, sigma_rules: Sequence[sigma.SigmaRule], signature_rules: Sequence[signatures.SignatureRule]
) -> dict[str, DataFrame]:
    """Everything about a set of files in lazily evaluated tables; all files are analysed by the same jobs."""
    indicators = ioc.extract_iocs(entries)
    results = file_results(entries, sigma_rules, signature_rules)
    scores = report.threat_scores(results, files=entries.select("file_id"))
    return {
        "iocs": indicators,
        "anomalies": anomalies(entries),
        "results": results,
        "techniques": attack.technique_scores(attack.map_iocs(indicators), attack.map_behaviours(entries)),
        "scores": scores,
        "summaries": report.executive_summary(scores, results),
    }

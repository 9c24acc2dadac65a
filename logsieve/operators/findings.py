"""The common shape of what detectors report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weights of a finding by severity and by type
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3}
TYPE_WEIGHTS = {
    "port_scan": 0.9,
    "impossible_travel": 0.95,
    "beaconing": 0.85,
    "suspicious_process": 0.8,
    "registry_modification": 0.85,
    "error_rate_spike": 0.7,
    "rapid_fire_events": 0.8,
}
DEFAULT_WEIGHT = 0.5


def to_findings(
    df: DataFrame,
    kind: str,
    severity: Column | str,
    confidence: Column | float,
    entity: Column,
    evidence: Mapping[str, Column],
    description: Column | None = None,
    ts: Column | None = None,
    detector: str = "anomaly",
) -> DataFrame:
    pairs = [x for n, c in evidence.items() for x in (F.lit(n), c.cast("string"))]
    level = F.lit(severity) if isinstance(severity, str) else severity
    trust = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(kind), entity.cast("string"), *[c.cast("string") for c in evidence.values()]), 256)
        .alias("finding_id"),
        F.lit(detector).alias("detector"),
        F.lit(kind).alias("type"),
        level.alias("severity"),
        trust.cast("double").alias("confidence"),
        finding_score(F.lit(kind), level, trust).alias("score"),
        entity.cast("string").alias("entity"),
        (ts if ts is not None else F.lit(None)).cast("timestamp").alias("ts"),
        (description if description is not None else F.lit(kind)).alias("description"),
        F.create_map(*pairs).alias("evidence"),
    )


def finding_score(kind: Column, severity: Column, confidence: Column) -> Column:
    def weight(col, table):
        pairs = [F.lit(x) for pair in table.items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(DEFAULT_WEIGHT))

    return weight(severity, SEVERITY_WEIGHTS) * weight(kind, TYPE_WEIGHTS) * F.coalesce(confidence, F.lit(0.5))


def score_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumn("score", finding_score(F.col("type"), F.col("severity"), F.col("confidence")))


def findings_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), F.avg("confidence").alias("mean_confidence")
    )


def severity_distribution(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """One sentence: critical and high counts and the three most frequent types."""
    per_type = findings.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    # one row per type is left, so the ordered list is as long as the catalogue of types
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "type")))
    total = per_type.agg(F.sum("critical").alias("c"), F.sum("high").alias("h"), ranked.alias("types"))
    top = F.array_join(
        F.transform(F.slice("types", 1, 3), lambda t: F.replace(t["type"], F.lit("_"), F.lit(" "))), ", "
    )
    sentence = F.concat_ws(
        ". ",
        F.when(F.col("c") > 0, F.concat(F.col("c").cast("string"), F.lit(" critical anomalies detected"))),
        F.when(F.col("h") > 0, F.concat(F.col("h").cast("string"), F.lit(" high-severity anomalies"))),
        F.concat(F.lit("Most common: "), top),
    )
    return total.select(
        F.when(F.size("types") == 0, "No significant anomalies detected.")
        .otherwise(F.concat(sentence, F.lit(".")))
        .alias("summary")
    )

"""Scores, summaries and advice per analysed file, all files in one job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.net import lookup
from logsieve.functions.rows import explode_computed
from logsieve.operators.stats import with_scalars

# fixed values: points of findings
SIGNATURE_POINTS = {"critical": 20, "high": 15, "medium": 10, "low": 5}
SIGMA_POINTS = {"critical": 18, "high": 13, "medium": 8, "low": 3}
SEVERE_TECHNIQUES = ("T1055", "T1003", "T1053", "T1547", "T1218")
SEVERE_TECHNIQUE_POINTS, TECHNIQUE_POINTS = 15, 8
PATTERN_POINTS, ANOMALY_POINTS = 5, 3
MAX_SCORE = 100
BANDS = ((75, "critical"), (50, "high"), (25, "medium"))
DEFAULT_CONFIDENCE = {"signature": 0.8, "sigma": 0.7, "technique": 0.7}
KEY_CONFIDENCE = {"sigma": 0.7, "technique": 0.8, "pattern": 0.75}


def severity_of(score: Column) -> Column:
    out = F.lit("low")
    for bound, name in reversed(BANDS):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def finding_points(kind: Column, level: Column, technique: Column) -> Column:
    return (
        F.when(kind == "signature", F.coalesce(lookup(level, SIGNATURE_POINTS), F.lit(0)))
        .when(kind == "sigma", F.coalesce(lookup(level, SIGMA_POINTS), F.lit(0)))
        .when(kind == "technique", F.when(technique.isin(*SEVERE_TECHNIQUES), SEVERE_TECHNIQUE_POINTS).otherwise(TECHNIQUE_POINTS))
        .when(kind == "pattern", PATTERN_POINTS)
        .when(kind == "anomaly", ANOMALY_POINTS)
        .otherwise(0)
    )


def reputation_points(malicious: Column) -> Column:
    return F.when(malicious > 10, 25).when(malicious > 5, 15).when(malicious > 0, 10).otherwise(0)


def threat_scores(results: DataFrame, reputation: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Score, confidence and severity per file.

    `results(file_id, kind, level, technique, confidence)` holds all findings; sums are
    combined before the shuffle. `files(file_id)` adds files without any finding.
    """
    default = F.coalesce(F.col("confidence"), lookup(F.col("kind"), DEFAULT_CONFIDENCE))
    rated = F.when(F.col("kind").isin(*DEFAULT_CONFIDENCE), default)
    per_file = results.groupBy("file_id").agg(
        F.sum(finding_points(F.col("kind"), F.col("level"), F.col("technique"))).alias("_points"),
        F.avg(rated).alias("_confidence"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("signature", "sigma", "technique", "pattern", "anomaly")],
    )
    if reputation is not None:
        per_file = per_file.join(reputation.select("file_id", F.col("malicious").alias("_mal")), "file_id", "full")
    else:
        per_file = per_file.withColumn("_mal", F.lit(0))
    if files is not None:
        per_file = files.select("file_id").distinct().join(per_file, "file_id", "left")
    points = F.coalesce("_points", F.lit(0)) + reputation_points(F.coalesce("_mal", F.lit(0)))
    scored = per_file.withColumn("threat_score", F.least(points, F.lit(MAX_SCORE)))
    return scored.select(
        "file_id",
        "threat_score",
        F.coalesce("_confidence", F.lit(0.5)).alias("confidence"),
        severity_of(F.col("threat_score")).alias("severity"),
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("signature", "sigma", "technique", "pattern", "anomaly")],
    )


def is_key_finding() -> Column:
    kind, confidence = F.col("kind"), F.col("confidence")
    return (
        ((kind == "signature") & F.col("level").isin("high", "critical"))
        | ((kind == "sigma") & (confidence > KEY_CONFIDENCE["sigma"]))
        | ((kind == "technique") & (confidence > KEY_CONFIDENCE["technique"]))
        | ((kind == "pattern") & (confidence > KEY_CONFIDENCE["pattern"]))
    )


def key_findings(results: DataFrame) -> DataFrame:
    """Findings worth naming, one row each."""
    return results.where(is_key_finding()).select("file_id", "kind", "name", "level", "confidence").distinct()


def top_names(results: DataFrame, kind: str, keep: int = 3) -> DataFrame:
    """First names of the key findings of a kind per file, and how many there are."""
    from logsieve.operators.fanout import first_values

    rows = key_findings(results).where(F.col("kind") == kind).select("file_id", "name").distinct()
    counts = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias(f"n_key_{kind}"))
    return first_values(rows, ["file_id"], "name", keep, f"top_{kind}").join(counts, "file_id")


SECTIONS = {
    "signature": ("MALWARE DETECTED", "indicator(s) found:"),
    "technique": ("ATTACK TECHNIQUES", "technique(s) identified:"),
    "pattern": ("SUSPICIOUS BEHAVIORS", "behavior(s) detected:"),
}
GENERAL_ADVICE = (
    "Document all findings for future reference", "Update threat intelligence feeds",
    "Consider threat hunting for similar indicators",
)
LEVEL_ADVICE = {
    "critical": (
        "IMMEDIATE ACTION REQUIRED: Isolate affected systems immediately", "Initiate incident response procedures",
        "Preserve evidence for forensic analysis", "Check for lateral movement to other systems",
    ),
    "high": (
        "Investigate identified threats promptly", "Review system logs for related activity",
        "Update security tools and signatures", "Consider enhanced monitoring",
    ),
}
WORD_ADVICE = {
    "signature": ("ransomware", ("Check and secure backups immediately", "Review file encryption activity")),
    "technique": (
        "persistence", ("Audit startup items and scheduled tasks", "Check for unauthorized registry modifications"),
    ),
    "pattern": (
        "exfiltration", ("Review outbound network connections", "Check for unauthorized data transfers"),
    ),
}


def executive_summary(scores: DataFrame, results: DataFrame) -> DataFrame:
    """A text and up to ten pieces of advice per file."""
    joined = scores
    for kind in SECTIONS:
        joined = joined.join(top_names(results, kind), "file_id", "left")
    words = results.groupBy("file_id").agg(
        *[
            F.coalesce(F.bool_or((F.col("kind") == kind) & F.lower("name").contains(word)), F.lit(False)).alias(f"_w_{kind}")
            for kind, (word, _) in WORD_ADVICE.items()
        ]
    )
    joined = joined.join(words, "file_id", "left")
    head = F.format_string(
        "Security analysis completed with threat score: %d/100 (Severity: %s, Confidence: %.1f%%)",
        F.col("threat_score").cast("int"), F.upper("severity"), F.col("confidence") * 100,
    )
    parts = [head]
    for kind, (title, tail) in SECTIONS.items():
        lines = F.array_join(F.transform(f"top_{kind}", lambda n: F.concat(F.lit("  - "), n)), "\n")
        parts.append(
            F.when(
                F.col(f"n_key_{kind}") > 0,
                F.concat(F.lit(f"\n{title}: "), F.col(f"n_key_{kind}").cast("string"), F.lit(f" {tail}\n"), lines),
            )
        )
    for kind, label in (("signature", "Signatures"), ("sigma", "Rules"), ("pattern", "Patterns"), ("anomaly", "Anomalies")):
        parts.append(F.concat(F.lit(f"  - {label}: "), F.col(f"n_{kind}").cast("string")))
    advice = [F.when(F.col("severity") == level, F.lit(a)) for level, texts in LEVEL_ADVICE.items() for a in texts]
    advice += [F.when(F.col(f"_w_{kind}"), F.lit(a)) for kind, (_, texts) in WORD_ADVICE.items() for a in texts]
    advice += [F.when(F.col("threat_score") > 0, F.lit(a)) for a in GENERAL_ADVICE]
    return joined.select(
        "file_id", F.concat_ws("\n", *parts).alias("summary"), F.slice(F.array_compact(F.array(*advice)), 1, 10).alias("advice")
    )


def severity_overview(entries: DataFrame, per: str = "file_id", severity: str = "severity", ts: str = "ts") -> DataFrame:
    """Counts by severity and the time range of each file."""
    levels = ("critical", "high", "medium", "low", "info")
    return entries.groupBy(per).agg(
        F.count(F.lit(1)).alias("entries"),
        *[F.count_if(F.col(severity) == level).alias(level) for level in levels],
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def first_entries(entries: DataFrame, per: str = "file_id", order_by: tuple[str, ...] = ("line_no",), keep: int = 50):
    """The first rows of each file as a sample."""
    from pyspark.sql import Window as W

    order = W.partitionBy(per).orderBy(*order_by)
    return entries.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)


POSTURE_BANDS = ((80, "strong"), (60, "moderate"), (40, "weak"))


def posture(entries: DataFrame, iocs: DataFrame, per: str = "file_id", level: str = "level") -> DataFrame:
    """100 less ten per critical row, two per error row and one per distinct IP up to twenty."""
    rows = entries.groupBy(per).agg(
        F.count_if(F.col(level) == "critical").alias("critical_rows"), F.count_if(F.col(level) == "error").alias("error_rows")
    )
    known = iocs.groupBy(per).agg(
        F.count_distinct(F.when(F.col("ioc_type") == "ips", F.col("ioc_value"))).alias("ips"),
        F.count_distinct(F.when(F.col("ioc_type") == "hashes", F.col("ioc_value"))).alias("hashes"),
    )
    joined = rows.join(known, per, "left").fillna(0, ["ips", "hashes"])
    score = F.greatest(
        F.lit(0), F.lit(100) - F.col("critical_rows") * 10 - F.col("error_rows") * 2 - F.least(F.col("ips"), F.lit(20))
    )
    rating = F.lit("critical")
    for bound, name in reversed(POSTURE_BANDS):
        rating = F.when(F.col("posture_score") >= bound, name).otherwise(rating)
    concerns = F.array_compact(
        F.array(
            F.when(F.col("critical_rows") > 0, F.lit("Critical severity events detected")),
            F.when(F.col("error_rows") > 10, F.lit("High number of error events")),
            F.when(F.col("ips") > 20, F.lit("Excessive number of IP addresses")),
            F.when(F.col("hashes") > 5, F.lit("Multiple file hashes detected")),
        )
    )
    return joined.withColumn("posture_score", score).withColumns({"rating": rating, "concerns": concerns})


# fixed values: wording of notes
BEHAVIOUR_NOTES = {
    "Multiple failed authentication attempts": r"failed.*login|authentication.*failed",
    "Network scanning activity": r"scan|scanning|nmap",
    "File download activity": r"download|wget|curl.*http",
    "Command execution": r"cmd\.exe|powershell|/bin/sh",
    "Possible ransomware activity": r"encrypt|ransom|locked",
    "Potential data exfiltration": r"exfil|upload.*data|transfer.*large",
}
VULNERABILITY_NOTES = {
    "Unpatched or outdated software detected": r"unpatched|outdated",
    "Weak or default passwords in use": r"weak password|default password",
    "Exposed services or open ports": r"open port|exposed service",
}


def notes(entries: DataFrame, iocs: DataFrame | None = None, per: str = "file_id", message: str = "message") -> DataFrame:
    """Distinct notes per file about behaviour, weaknesses and unusually many indicators."""
    low = F.lower(message)

    def tagged(kind: str, table: Mapping[str, str]):
        return [
            F.when(low.rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("note"))) for n, p in table.items()
        ]

    found = F.array_compact(F.array(*tagged("behaviour", BEHAVIOUR_NOTES), *tagged("vulnerability", VULNERABILITY_NOTES)))
    rows = explode_computed(entries, [per], found, "_n").select(per, "_n.*").distinct()
    if iocs is None:
        return rows
    counts = iocs.groupBy(per).agg(
        F.count_distinct(F.when(F.col("ioc_type") == "ips", F.col("ioc_value"))).alias("ips"),
        F.count_distinct(F.when(F.col("ioc_type") == "domains", F.col("ioc_value"))).alias("domains"),
    )
    many = F.array_compact(
        F.array(
            F.when(F.col("ips") > 10, F.lit("Multiple suspicious IP addresses detected")),
            F.when(F.col("domains") > 5, F.lit("Multiple suspicious domains detected")),
        )
    )
    more = explode_computed(counts, [per], many, "note").select(per, F.lit("behaviour").alias("kind"), "note")
    return rows.unionByName(more)


LEVEL_SCORES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 0}


def combined_level(level: Column, risk_score: Column, priority_iocs: Column) -> Column:
    """Mean of what three analyses say, back to a level; absent analyses (null) do not count."""
    by_risk = F.when(risk_score.isNotNull(), F.when(risk_score >= 80, 4).when(risk_score >= 60, 3).when(risk_score >= 40, 2).otherwise(1))
    by_iocs = F.when(priority_iocs >= 5, 4).when(priority_iocs >= 2, 3).when(priority_iocs >= 1, 2)
    by_level = F.when(level.isNotNull(), F.coalesce(lookup(level, LEVEL_SCORES), F.lit(0)))
    scores = F.array_compact(F.array(by_level, by_risk, by_iocs))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return (
        F.when(F.size(scores) == 0, "unknown").when(mean >= 3.5, "critical").when(mean >= 2.5, "high")
        .when(mean >= 1.5, "medium").otherwise("low")
    )


def combined_confidence(given: Column, anomalies: Column, pattern_confidence: Column) -> Column:
    by_anomalies = F.when(anomalies > 0, F.least(F.lit(0.6) + anomalies * 0.1, F.lit(0.95)))
    parts = F.array_compact(F.array(given, by_anomalies, pattern_confidence))
    return F.when(F.size(parts) == 0, 0.5).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def totals(scores: DataFrame) -> DataFrame:
    """One row over all files analysed together."""
    summed = scores.agg(
        F.count(F.lit(1)).alias("files"), F.max("threat_score").alias("max_score"), F.avg("threat_score").alias("mean_score")
    )
    worst = scores.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("urgent_files"))
    return with_scalars(summed, worst)

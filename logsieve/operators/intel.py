"""Joins with threat-intelligence feeds and reputation reports loaded as tables.

Indicators are reduced to distinct values before they meet a feed, so an indicator that
fills a third of all rows still joins as one row. No side is broadcast by hand: the size
of a feed is not known here, adaptive execution decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed

LOCAL_CONFIDENCE = 0.95
LOCAL_SCORE = 80


def match_feed(iocs: DataFrame, feed: DataFrame) -> DataFrame:
    """Distinct indicators found in `feed(ioc_type, ioc_value, threat_type, tag)`, with all their threat types."""
    values = iocs.groupBy("ioc_type", "ioc_value").agg(F.count(F.lit(1)).alias("mentions"))
    listed = feed.select("ioc_type", "ioc_value", "threat_type", "tag").distinct()
    return (
        values.join(listed, ["ioc_type", "ioc_value"])
        .groupBy("ioc_type", "ioc_value", "mentions")
        .agg(
            F.array_sort(F.collect_set("threat_type")).alias("threat_types"),
            F.array_sort(F.collect_set("tag")).alias("tags"),
        )
        .withColumns({"confidence": F.lit(LOCAL_CONFIDENCE), "threat_score": F.lit(LOCAL_SCORE)})
    )


def entries_matching_feed(iocs: DataFrame, feed: DataFrame) -> DataFrame:
    """Entries with a listed indicator."""
    return iocs.join(feed.select("ioc_type", "ioc_value").distinct(), ["ioc_type", "ioc_value"], "left_semi")


def ioc_context(reports: DataFrame) -> DataFrame:
    """All sources of an indicator together.

    Names of threats and tags are deduplicated row-wise before they are gathered, so a
    list is as long as the vocabulary, not as the number of reports.
    """
    key = ["ioc_type", "ioc_value"]
    per_source = reports.groupBy(*key, "source").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("is_malicious")).alias("_bad"),
        F.max("threat_score").alias("_score"),
        F.sum("confidence").alias("_confidence"),
    )
    context = per_source.groupBy(*key).agg(
        F.sum("_n").alias("reports"),
        F.count(F.lit(1)).alias("sources"),
        F.sum("_bad").alias("malicious_reports"),
        (F.sum("_bad") > 0).alias("is_malicious"),
        F.max("_score").alias("max_threat_score"),
        (F.sum("_confidence") / F.sum("_n")).alias("average_confidence"),
        # one entry per feed provider
        F.map_from_entries(F.collect_list(F.struct("source", "_score"))).alias("source_scores"),
    )
    names = (
        reports.select(*key, F.explode("threat_types").alias("_t")).distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_list("_t")).alias("threat_types"))
    )
    tags = (
        reports.select(*key, F.explode("tags").alias("_g")).distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_list("_g")).alias("tags"))
    )
    return context.join(names, key, "left").join(tags, key, "left")


ADVICE = {
    "malicious": (
        "Block this IOC immediately", "Check for related IOCs", "Review logs for historical activity",
    ),
    "suspicious": ("Monitor activity from this IOC", "Consider additional investigation"),
}


def verdicts(context: DataFrame) -> DataFrame:
    """Share of malicious reports to a verdict."""
    share = F.col("malicious_reports") / F.col("reports")
    verdict = F.when(share >= 0.7, "malicious").when(share >= 0.3, "suspicious").otherwise("clean")
    advice = F.when(verdict == "malicious", F.array(*[F.lit(a) for a in ADVICE["malicious"]])).when(
        verdict == "suspicious", F.array(*[F.lit(a) for a in ADVICE["suspicious"]])
    ).otherwise(F.array().cast("array<string>"))
    return context.withColumns({"verdict": verdict, "advice": advice})


def detection_rate(malicious: Column, suspicious: Column, harmless: Column, undetected: Column) -> Column:
    total = malicious + suspicious + harmless + undetected
    return F.when(total == 0, F.lit(0.0)).otherwise((malicious + suspicious) / total * 100)


def file_severity(rate: Column, reputation: Column) -> Column:
    return (
        F.when((rate > 50) | (reputation < -50), "critical").when((rate > 25) | (reputation < -20), "high")
        .when((rate > 10) | (reputation < 0), "medium").when(rate > 0, "low").otherwise("clean")
    )


def host_severity(malicious: Column, reputation: Column) -> Column:
    return (
        F.when((malicious > 5) | (reputation < -50), "critical").when((malicious > 2) | (reputation < -20), "high")
        .when((malicious > 0) | (reputation < 0), "medium").otherwise("clean")
    )


def url_severity(rate: Column, categories: Column) -> Column:
    dangerous = F.lower(categories).rlike("phishing|malware|malicious")
    return (
        F.when((rate > 30) | F.coalesce(dangerous, F.lit(False)), "critical").when(rate > 15, "high")
        .when(rate > 5, "medium").when(rate > 0, "low").otherwise("clean")
    )


def report_severity(reports: DataFrame) -> DataFrame:
    """Rate and severity by kind of resource over columns malicious, suspicious, harmless, undetected, reputation."""
    rate = detection_rate(*[F.col(c) for c in ("malicious", "suspicious", "harmless", "undetected")])
    kind = F.col("resource_type")
    severity = (
        F.when(kind == "file", file_severity(F.col("detection_rate"), F.col("reputation")))
        .when(kind == "url", url_severity(F.col("detection_rate"), F.col("categories")))
        .otherwise(host_severity(F.col("malicious"), F.col("reputation")))
    )
    return reports.withColumn("detection_rate", rate).withColumn("severity", severity)


def reputation_stats(reports: DataFrame) -> DataFrame:
    """Counts per resource type and the mean of positive counts above zero."""
    positives = F.col("malicious") + F.col("suspicious")
    return reports.groupBy("resource_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("malicious") > 0).alias("malicious_count"),
        F.count_if((F.col("malicious") == 0) & (F.col("suspicious") > 0)).alias("suspicious_count"),
        F.count_if(positives == 0).alias("clean_count"),
        F.coalesce(F.avg(F.when(positives > 0, positives)), F.lit(0.0)).alias("avg_positives"),
    )


def top_threats(reports: DataFrame, results: str = "results", limit: int = 10) -> DataFrame:
    """Most frequent threat names over the engine results of all reports."""
    names = reports.select(F.explode(F.map_values(results)).alias("threat")).where(F.col("threat").isNotNull())
    return (
        names.groupBy("threat").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "threat").limit(limit)
    )


def threat_names(reports: DataFrame, key: Sequence[str], results: str = "results", limit: int = 10) -> DataFrame:
    """First ten distinct names of each report in order."""
    from logsieve.operators.fanout import first_values

    rows = reports.select(*key, F.explode(F.map_values(results)).alias("threat")).where(
        F.col("threat").isNotNull() & ~F.col("threat").isin("", "malicious")
    )
    return first_values(rows, key, "threat", limit, "threat_names")


DNS_TYPES = ("A", "AAAA", "MX", "NS", "TXT")


def dns_pivot(records: DataFrame, key: Sequence[str], kind: str = "type", value: str = "value") -> DataFrame:
    """One column per record type, with the distinct values of each resource."""
    rows = records.where(F.col(kind).isin(*DNS_TYPES) & (F.col(value) != "")).select(*key, kind, value).distinct()
    return rows.groupBy(*key).pivot(kind, list(DNS_TYPES)).agg(F.array_sort(F.collect_list(value)))


def behaviour_iocs(reports: DataFrame, keep: Sequence[str], sections: Sequence[str]) -> DataFrame:
    """Rows (section, value) out of array columns of a behaviour report."""
    def tagged(section):
        values = F.coalesce(F.col(section), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(section).alias("section"), v.alias("ioc_value")))

    rows = explode_computed(reports, keep, F.concat(*[tagged(x) for x in sections]), "_b")
    return rows.select(*keep, "_b.*").distinct()


def latest_reports(reports: DataFrame, key: Sequence[str], ts: str = "report_ts") -> DataFrame:
    """Newest report per resource, of equally new ones the first by content; ranking is cut per partition before the shuffle."""
    order = W.partitionBy(*key).orderBy(F.desc(ts), F.to_json(F.struct("*")))
    return reports.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def lookup_reputation(
    iocs: DataFrame, reports: DataFrame, as_of: Column, max_age_seconds: float, ts: str = "report_ts"
) -> DataFrame:
    """Each distinct indicator with its newest report, or `unknown` when that is missing or too old."""
    key = ["ioc_type", "ioc_value"]
    newest = latest_reports(reports, key, ts)
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    fresh = newest.where(age <= max_age_seconds).withColumn("status", F.lit("known"))
    values = iocs.select(*key).distinct()
    return values.join(fresh, key, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))

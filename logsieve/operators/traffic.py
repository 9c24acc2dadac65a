"""Flows, packets and sensor events: projections, scans, large transfers, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import net
from logsieve.functions.clock import time_bucket
from logsieve.functions.text import contains_any

SCAN_SECONDS, SCAN_PORTS, SCAN_HOSTS = 60, 20, 20
LARGE_TRANSFER, USUAL_TRANSFER_PORTS = 10_000_000, (80, 443, 22)
UNUSUAL_TRAFFIC = 100_000_000
SUSPICIOUS_HTTP = ("/admin", "/shell", "/cmd", ".php", ".asp", "../")


def flows(df: DataFrame) -> DataFrame:
    """Decoded flow records (src_addr, dst_addr, ports, protocol number, packets, bytes, tcp_flags, first, last)."""
    flags = F.col("tcp_flags").cast("int")
    protocol = F.coalesce(net.lookup(F.col("protocol").cast("int"), net.PROTOCOLS), F.concat(F.lit("Protocol-"), F.col("protocol").cast("string")))
    names = net.tcp_flag_names(flags)
    duration = F.greatest(F.lit(0.0), (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6)
    message = F.concat(
        protocol, F.lit(" "), "src_addr", F.lit(":"), F.col("src_port").cast("string"), F.lit(" -> "), "dst_addr", F.lit(":"),
        F.col("dst_port").cast("string"),
    )
    return df.select(
        F.col("first").cast("timestamp").alias("ts"), F.col("src_addr").alias("src"), F.col("dst_addr").alias("dst"),
        F.col("src_port").cast("int").alias("src_port"), F.col("dst_port").cast("int").alias("dst_port"), protocol.alias("protocol"),
        F.col("packets").cast("long").alias("packets"), F.col("bytes").cast("long").alias("bytes"), duration.alias("duration"),
        names.alias("flags"), net.tcp_flag_tags(flags).alias("flag_tags"), message.alias("message"),
        F.when((protocol == "TCP") & net.has_suspicious_flags(flags), "warning").otherwise("info").alias("severity"),
    )


def packets(df: DataFrame) -> DataFrame:
    """Decoded packets as events. Columns a packet does not have may be null:
    ts, src_ip, dst_ip, protocol, src_port, dst_port, tcp_flags, http_path, dns_query, icmp_type, arp_op, arp_dst_mac."""
    c, proto = F.col, F.upper("protocol")
    flags = F.coalesce(c("tcp_flags").cast("int"), F.lit(0))
    syn = (flags.bitwiseAND(0x02) != 0) & (flags.bitwiseAND(0x10) == 0)
    risky = F.coalesce(c("dst_port").isin(*net.PACKET_PORTS), F.lit(False)) | F.coalesce(c("src_port").isin(*net.PACKET_PORTS), F.lit(False))
    low_syn = (proto == "TCP") & syn & (c("dst_port") < 1024)
    kind = (
        F.when(proto == "ARP", "network_arp").when(proto == "ICMP", "network_icmp").when(c("dns_query").isNotNull(), "network_dns")
        .when(c("http_path").isNotNull(), "network_http").when(F.coalesce(low_syn, F.lit(False)), "network_scan")
        .when(proto == "TCP", "network_tcp").otherwise("network_udp")
    )
    severity = (
        F.when(c("event_type") == "network_http", F.when(contains_any(F.lower("http_path"), SUSPICIOUS_HTTP), "high").otherwise("info"))
        .when(c("event_type") == "network_icmp", F.when(c("icmp_type") == 3, "medium").otherwise("info"))
        .when(c("event_type") == "network_arp", F.when((c("arp_op") == 2) & (c("arp_dst_mac") == "ff:ff:ff:ff:ff:ff"), "high").otherwise("info"))
        .when(c("event_type") == "network_scan", "high")
        .when(c("event_type").isin("network_tcp", "network_udp") & risky, "medium")
        .otherwise("info")
    )
    return df.withColumn("event_type", kind).withColumn("severity", severity)


def scans(
    df: DataFrame, value: str, src: str = "src", ts: str = "ts", seconds: int = SCAN_SECONDS, at_least: int = SCAN_PORTS, name: str = "distinct_values"
) -> DataFrame:
    """Sources with many distinct ports or hosts within one minute."""
    return (
        df.groupBy(src, time_bucket(F.col(ts), seconds).alias("bucket"))
        .agg(F.count_distinct(value).alias(name), F.count(F.lit(1)).alias("flows"))
        .where(F.col(name) >= at_least)
    )


def flow_port_scan(df: DataFrame, **kwargs) -> DataFrame:
    return scans(df, "dst_port", name="ports", **{"at_least": SCAN_PORTS, **kwargs})


def flow_network_scan(df: DataFrame, **kwargs) -> DataFrame:
    return scans(df, "dst", name="hosts", **{"at_least": SCAN_HOSTS, **kwargs})


def large_transfers(df: DataFrame, over: float = LARGE_TRANSFER, usual: Sequence[int] = USUAL_TRANSFER_PORTS) -> DataFrame:
    return df.where((F.col("bytes") > over) & ~F.col("dst_port").isin(*usual))


def risky_port_access(df: DataFrame) -> DataFrame:
    """Flows to ports seen in attacks; four of them raise an alert."""
    hits = df.where(F.col("dst_port").isin(*net.RISKY_PORTS))
    return hits.withColumns(
        {
            "tag": F.concat(F.lit("suspicious_port_"), F.col("dst_port").cast("string")),
            "service": F.coalesce(net.lookup(F.col("dst_port").cast("int"), net.SERVICES), F.lit("Unknown")),
            "alert": F.col("dst_port").isin(*net.ATTACKED_PORTS),
        }
    )


def top_talkers(df: DataFrame, src: str = "src", limit: int = 10) -> DataFrame:
    return (
        df.groupBy(src).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count(F.lit(1)).alias("flows"))
        .orderBy(F.desc("bytes"), src).limit(limit)
    )


def unusual_traffic(
    df: DataFrame, src: str = "src", limit: int = 10, over: float = UNUSUAL_TRAFFIC, ordinary: Sequence[int] = net.ORDINARY_PORTS
) -> DataFrame:
    """Of the sources with most bytes, those that send much to unusual ports."""
    unusual = F.sum(F.when(~F.col("dst_port").isin(*ordinary), F.col("bytes")))
    top = (
        df.groupBy(src).agg(F.sum("bytes").alias("bytes"), F.coalesce(unusual, F.lit(0)).alias("unusual_bytes"))
        .orderBy(F.desc("bytes"), src).limit(limit)
    )
    return top.where(F.col("unusual_bytes") > over)


def flow_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.sum("bytes").alias("total_bytes"), F.sum("packets").alias("total_packets"), F.count(F.lit(1)).alias("total_flows")
    ).withColumn("avg_flow_size", F.floor(F.col("total_bytes") / F.greatest(F.col("total_flows"), F.lit(1))))


def protocol_mix(df: DataFrame, protocol: str = "protocol") -> DataFrame:
    return df.groupBy(protocol).agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"))


def risky_port_usage(df: DataFrame, src: str = "src", ports: Sequence[int] = net.RISKY_PORTS) -> DataFrame:
    return (
        df.where(F.col("dst_port").isin(*ports))
        .groupBy("dst_port")
        .agg(F.count(F.lit(1)).alias("access_count"), F.count_distinct(src).alias("unique_sources"))
        .withColumn("service", F.coalesce(net.lookup(F.col("dst_port").cast("int"), net.SERVICES), F.lit("Unknown")))
    )


def top_counts(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    """Most frequent values of several columns in one pass, as (facet, value, n)."""
    from pyspark.sql import Window as W

    cols = [F.col(c).cast("string").alias(c) for c in columns]
    # one set per column: the bit of a column is 0 where it is kept
    sets = df.select(*cols).groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n")
    )
    full = (1 << len(columns)) - 1
    facet = F.lit(None).cast("string")
    for i, name in enumerate(columns):
        facet = F.when(F.col("_g") == full - (1 << (len(columns) - 1 - i)), name).otherwise(facet)
    named = sets.select(facet.alias("facet"), F.coalesce(*columns).alias("value"), "n").where(F.col("value").isNotNull())
    order = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    return named.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def packet_streams(df: DataFrame, size: str = "length") -> DataFrame:
    """Packets and bytes per stream between two ends, in either direction."""
    a = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    b = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    return df.groupBy(F.least(a, b).alias("end_a"), F.greatest(a, b).alias("end_b")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes")
    )


def uid_correlation(events: DataFrame, uid: str = "uid", ts: str = "ts") -> DataFrame:
    """Sensor events of different logs that belong to one connection."""
    size = F.lit(0)
    for name in ("orig_bytes", "resp_bytes", "total_bytes"):
        if name in events.columns:
            size = size + F.coalesce(F.col(name), F.lit(0))
    threat = F.col("severity").isin("high", "critical") | (F.size("suspicious") > 0)
    return (
        events.where(F.coalesce(F.col(uid), F.lit("")) != "")
        .groupBy(uid)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.array_sort(F.collect_set("log_type")).alias("log_types"),
            ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6).alias("duration"),
            F.sum(size).alias("total_bytes"),
            F.coalesce(F.bool_or(threat), F.lit(False)).alias("has_threat"),
        )
        .where(F.col("event_count") > 1)
    )


def with_correlation(events: DataFrame, correlation: DataFrame, uid: str = "uid") -> DataFrame:
    """Events with what is known of their connection."""
    named = correlation.select(uid, F.struct("event_count", "log_types", "duration", "total_bytes", "has_threat").alias("correlation"))
    return events.join(named, uid, "left")


def hourly_timeline(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def suspicious_rate(events: DataFrame, flag: Column | None = None) -> DataFrame:
    hit = flag if flag is not None else F.size("suspicious") > 0
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(hit).alias("suspicious_events")).withColumn(
        "suspicious_rate", F.try_divide(F.col("suspicious_events") * 100, F.col("events"))
    )

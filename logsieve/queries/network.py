"""Flows, packets and sensor logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import net
from logsieve.functions import text as txt
from logsieve.operators import traffic
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query
from logsieve.queries.scalars import count_chars_sql
from logsieve.sources import zeek

PROTO_ROWS = [[k, v] for k, v in net.PROTOCOLS.items()]


def raw_flows(spark, sf_dir):
    ts = F.col("ts")
    pick = lambda c, n: (c % n).cast("int")
    return adapt.flows(spark, sf_dir).select(
        "flow_id", F.concat(F.lit("10.0.0."), F.col("src").cast("string")).alias("src_addr"), F.concat(F.lit("10.1.0."), F.col("dst").cast("string")).alias("dst_addr"),
        pick(F.col("src") * 7 + 1000, 65535).alias("src_port"), pick(F.col("dst_port"), 1024).alias("dst_port"), pick(F.col("dst_port"), 20).alias("protocol"),
        F.col("packets"), F.floor("bytes").alias("bytes"), pick(F.col("dst_port"), 64).alias("tcp_flags"), ts.alias("first"),
        F.timestamp_micros(F.unix_micros(ts) + (F.col("packets") - 5).cast("long") * 1_000_000).alias("last"),
    )


@query(
    "flow_records",
    s.with_ctes(
        "flows",
        f""", p AS {s.values(PROTO_ROWS, 'no', 'pname')}, f AS (SELECT flow_id, bytes, packets, src, dst, dst_port % 1024 AS port, dst_port % 64 AS fl, dst_port % 20 AS proto, (src * 7 + 1000) % 65535 AS sp FROM flows)
        SELECT port AS dst_port, coalesce(pname, 'Protocol-' || proto) AS protocol, count(*) AS n, CAST(sum(floor(bytes)) AS BIGINT) AS bytes, CAST(sum(greatest(0, packets - 5)) AS BIGINT) AS duration,
          concat_ws(',', """ + ", ".join(f"CASE WHEN fl & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(net.TCP_FLAGS)) + """) AS flags,
          CASE WHEN pname = 'TCP' AND (fl = 0 OR (fl & 41) = 41 OR (fl & 3) = 3) THEN 'warning' ELSE 'info' END AS severity,
          min(coalesce(pname, 'Protocol-' || proto) || ' 10.0.0.' || src || ':' || sp || ' -> 10.1.0.' || dst || ':' || port) AS first_message
        FROM f LEFT JOIN p ON no = proto GROUP BY ALL""",
    ),
)
def flow_records(spark, sf_dir):
    found = traffic.flows(raw_flows(spark, sf_dir))
    return found.groupBy("dst_port", "protocol", F.array_join("flags", ",").alias("flags"), "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("duration").cast("long").alias("duration"), F.min("message").alias("first_message")
    )


def raw_packets(spark, sf_dir):
    k, n = F.col("k"), F.col("event_id")
    kind = n % 6
    st = lambda c: c.cast("string")
    return adapt.log_events(spark, sf_dir).select(
        "event_id", "ts", F.concat(F.lit("10.0.0."), st(k)).alias("src_ip"), F.concat(F.lit("10.0.1."), st(k % 7)).alias("dst_ip"),
        F.when(kind <= 2, "TCP").when(kind == 3, "UDP").when(kind == 4, "ICMP").otherwise("ARP").alias("protocol"),
        (k + 1000).alias("src_port"), (k * 40 % 4000).alias("dst_port"), F.when(kind == 1, 2).otherwise(16).alias("tcp_flags"),
        F.when(kind == 2, F.concat(F.lit("/x"), F.when(k % 2 == 0, "/admin").otherwise(".html"))).alias("http_path"),
        F.when((kind == 3) & (k % 2 == 0), "a.example.com").alias("dns_query"), (k % 5).alias("icmp_type"), (k % 3).alias("arp_op"),
        F.when(k % 4 == 2, "ff:ff:ff:ff:ff:ff").otherwise("aa").alias("arp_dst_mac"), (k + 40).alias("length"),
    )


PACKETS_SQL = f""", pk AS (SELECT event_id, event_id % 6 AS kind, k, k * 40 % 4000 AS dp, '10.0.0.' || k AS src_ip, '10.0.1.' || (k % 7) AS dst_ip, k + 1000 AS sp, k + 40 AS length FROM log_events),
    pe AS (SELECT *, CASE WHEN kind = 5 THEN 'network_arp' WHEN kind = 4 THEN 'network_icmp' WHEN kind = 3 AND k % 2 = 0 THEN 'network_dns' WHEN kind = 2 THEN 'network_http'
        WHEN kind = 1 AND dp < 1024 THEN 'network_scan' WHEN kind <= 2 THEN 'network_tcp' ELSE 'network_udp' END AS event_type FROM pk),
    ps AS (SELECT *, CASE WHEN event_type = 'network_http' THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'info' END WHEN event_type = 'network_icmp' THEN CASE WHEN k % 5 = 3 THEN 'medium' ELSE 'info' END
        WHEN event_type = 'network_arp' THEN CASE WHEN k % 3 = 2 AND k % 4 = 2 THEN 'high' ELSE 'info' END WHEN event_type = 'network_scan' THEN 'high'
        WHEN event_type IN ('network_tcp', 'network_udp') AND dp IN {net.PACKET_PORTS} THEN 'medium' ELSE 'info' END AS severity FROM pe)"""


@query("packet_events", s.with_ctes("log_events", PACKETS_SQL + " SELECT event_id, event_type, severity FROM ps"))
def packet_events(spark, sf_dir):
    return traffic.packets(raw_packets(spark, sf_dir)).select("event_id", "event_type", "severity")


@query(
    "packet_top_counts",
    s.with_ctes(
        "log_events",
        PACKETS_SQL + """, u AS (SELECT 'event_type' AS facet, event_type AS value FROM ps UNION ALL SELECT 'src_ip', src_ip FROM ps UNION ALL SELECT 'dst_port', CAST(dp AS VARCHAR) FROM ps),
        c AS (SELECT facet, value, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM c)
        SELECT facet, value, n FROM r WHERE rn <= 10""",
    ),
)
def packet_top_counts(spark, sf_dir):
    return traffic.top_counts(traffic.packets(raw_packets(spark, sf_dir)), ["event_type", "src_ip", "dst_port"])


@query(
    "packet_streams",
    s.with_ctes(
        "log_events",
        PACKETS_SQL + """, e AS (SELECT src_ip || ':' || sp AS a, dst_ip || ':' || dp AS b, length FROM pk)
        SELECT least(a, b) AS end_a, greatest(a, b) AS end_b, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM e GROUP BY 1, 2""",
    ),
)
def packet_streams(spark, sf_dir):
    return traffic.packet_streams(raw_packets(spark, sf_dir))


@query(
    "flow_port_scan",
    s.with_ctes("flows", "SELECT src, us // 604800000000 AS week, count(DISTINCT dst_port) AS ports, count(*) AS flows FROM flows GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 4"),
)
def flow_port_scan(spark, sf_dir):
    found = traffic.flow_port_scan(adapt.flows(spark, sf_dir), seconds=604800, at_least=4)
    return found.select("src", F.floor(F.unix_seconds("bucket") / 604800).alias("week"), "ports", "flows")


@query(
    "flow_network_scan",
    s.with_ctes("flows", "SELECT src, us // 604800000000 AS week, count(DISTINCT dst) AS hosts, count(*) AS flows FROM flows GROUP BY 1, 2 HAVING count(DISTINCT dst) >= 4"),
)
def flow_network_scan(spark, sf_dir):
    found = traffic.flow_network_scan(adapt.flows(spark, sf_dir), seconds=604800, at_least=4)
    return found.select("src", F.floor(F.unix_seconds("bucket") / 604800).alias("week"), "hosts", "flows")


@query(
    "large_transfers",
    s.with_ctes("flows", "SELECT flow_id, dst_port, round(bytes, 6) AS bytes FROM flows WHERE bytes > 90000 AND dst_port NOT IN (80, 443, 22)"),
)
def large_transfers(spark, sf_dir):
    return rounded(traffic.large_transfers(adapt.flows(spark, sf_dir), over=90_000).select("flow_id", "dst_port", "bytes"))


SERVICE_ROWS = [[k, v] for k, v in net.SERVICES.items()]


@query(
    "risky_port_access",
    s.with_ctes(
        "flows",
        f""", sv AS {s.values(SERVICE_ROWS, 'no', 'service')} SELECT flow_id, dst_port, 'suspicious_port_' || dst_port AS tag, coalesce(service, 'Unknown') AS service,
        dst_port IN {net.ATTACKED_PORTS} AS alert FROM flows LEFT JOIN sv ON no = dst_port WHERE dst_port IN {net.RISKY_PORTS}""",
    ),
)
def risky_port_access(spark, sf_dir):
    return traffic.risky_port_access(adapt.flows(spark, sf_dir)).select("flow_id", "dst_port", "tag", "service", "alert")


@query(
    "risky_port_usage",
    s.with_ctes(
        "flows",
        f""", sv AS {s.values(SERVICE_ROWS, 'no', 'service')} SELECT dst_port, coalesce(service, 'Unknown') AS service, count(*) AS access_count, count(DISTINCT src) AS unique_sources
        FROM flows LEFT JOIN sv ON no = dst_port WHERE dst_port IN {net.RISKY_PORTS} GROUP BY 1, 2""",
    ),
)
def risky_port_usage(spark, sf_dir):
    return traffic.risky_port_usage(adapt.flows(spark, sf_dir))


@query(
    "top_talkers",
    s.with_ctes("flows", "SELECT src, round(sum(bytes), 2) AS bytes, sum(packets) AS packets, count(*) AS flows FROM flows GROUP BY 1 ORDER BY sum(bytes) DESC, src LIMIT 10"),
)
def top_talkers(spark, sf_dir):
    return rounded(traffic.top_talkers(adapt.flows(spark, sf_dir)), 2)


@query(
    "unusual_traffic",
    s.with_ctes(
        "flows",
        f""", t AS (SELECT src, sum(bytes) AS bytes, sum(bytes) FILTER (dst_port NOT IN {net.ORDINARY_PORTS}) AS unusual_bytes FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT src, round(bytes, 2) AS bytes, round(unusual_bytes, 2) AS unusual_bytes FROM t WHERE unusual_bytes > 1000000""",
    ),
)
def unusual_traffic(spark, sf_dir):
    return rounded(traffic.unusual_traffic(adapt.flows(spark, sf_dir), over=1_000_000), 2)


@query(
    "flow_summary",
    s.with_ctes("flows", "SELECT round(sum(bytes), 0) AS total_bytes, sum(packets) AS total_packets, count(*) AS total_flows, CAST(floor(sum(bytes) / count(*)) AS BIGINT) AS avg_flow_size FROM flows"),
)
def flow_summary(spark, sf_dir):
    return rounded(traffic.flow_summary(adapt.flows(spark, sf_dir)), 0)


@query(
    "protocol_mix",
    s.with_ctes(
        "flows",
        f""", p AS {s.values(PROTO_ROWS, 'no', 'pname')} SELECT coalesce(pname, 'Protocol-' || (dst_port % 20)) AS protocol, count(*) AS flows, CAST(sum(floor(bytes)) AS BIGINT) AS bytes
        FROM flows LEFT JOIN p ON no = dst_port % 20 GROUP BY 1""",
    ),
)
def protocol_mix(spark, sf_dir):
    return traffic.protocol_mix(traffic.flows(raw_flows(spark, sf_dir)))


# one table with the fields of all sensor logs, made of events
def sensor_rows(spark, sf_dir):
    k, n = F.col("k"), F.col("event_id")
    st = lambda c: c.cast("string")
    states = [F.lit(x) for x in ("S0", "SF", "REJ", "RSTR", "OTH", "S1", "RSTOS0")]
    uris = [F.lit(x) for x in ("/index", "/q?a=union select 1", "/../x", "/<script>", "/p:4444")]
    names = [F.lit(x) for x in ("example.com", "qwrtzpsd.info", "login.evil.tk", "abcdefghij.org", "")]
    mimes = [F.lit(x) for x in ("text/html", "application/x-dosexec", "application/x-elf", "image/png")]
    statuses = [F.lit(x) for x in ("ok", "self signed certificate", "", "certificate expired")]
    versions = [F.lit(x) for x in ("TLSv12", "TLSv10", "SSLv3")]
    pick = lambda xs: F.element_at(F.array(*xs), k % len(xs) + 1)
    return adapt.log_events(spark, sf_dir).select(
        F.unix_seconds("ts").cast("double").alias("ts"), F.concat(F.lit("C"), st(n % 4000)).alias("uid"), F.concat(F.lit("10.0.0."), st(k)).alias("id.orig_h"),
        (k * 13 + 600).alias("id.orig_p"), F.concat(F.lit("203.0.113."), st(k % 9)).alias("id.resp_h"), F.when(k % 11 == 0, 4444).otherwise(443).alias("id.resp_p"),
        F.lit("tcp").alias("proto"), F.when(k % 2 == 0, "http").alias("service"), (k * 1.5).alias("duration"), (k * 10).cast("long").alias("orig_bytes"),
        (k * 20).cast("long").alias("resp_bytes"), pick(states).alias("conn_state"), F.lit("GET").alias("method"), F.lit("h").alias("host"), pick(uris).alias("uri"),
        F.when(k % 4 == 0, 200).when(k % 4 == 1, 404).otherwise(503).alias("status_code"), F.when(k % 10 == 3, "bob").alias("username"),
        pick(names).alias("query"), F.when(k % 3 == 0, "TXT").otherwise("A").alias("qtype_name"), F.when(k % 6 == 1, "NXDOMAIN").when(k % 6 == 2, "").otherwise("NOERROR").alias("rcode_name"),
        pick(versions).alias("version"), pick(statuses).alias("validation_status"), pick(mimes).alias("mime_type"),
        F.when(k % 5 == 0, "a.EXE").when(k % 5 == 1, "b.pdf").otherwise("").alias("filename"), (k * 2_000_000).cast("long").alias("total_bytes"),
        F.concat(F.lit("10.9.9.9:"), st(k)).alias("src"), F.lit("10.8.8.8").alias("dst"), F.lit("Scan::Port").alias("note"), F.concat(F.lit("F"), st(n)).alias("fuid"), n.alias("row"),
    )


def _pick(options):
    return f"[{', '.join(s.text(o) for o in options)}][k % {len(options)} + 1]"


SENSOR_SQL = f""", z AS (SELECT event_id, k, 'C' || (event_id % 4000) AS uid, us // 1000000 AS at_s, k * 13 + 600 AS op, CASE WHEN k % 11 = 0 THEN 4444 ELSE 443 END AS rp,
    {_pick(('S0', 'SF', 'REJ', 'RSTR', 'OTH', 'S1', 'RSTOS0'))} AS st, {_pick(('/index', '/q?a=union select 1', '/../x', '/<script>', '/p:4444'))} AS uri,
    CASE k % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 503 END AS code, CASE WHEN k % 10 = 3 THEN 'bob' ELSE '' END AS usr,
    {_pick(('example.com', 'qwrtzpsd.info', 'login.evil.tk', 'abcdefghij.org', ''))} AS qn, CASE WHEN k % 6 = 1 THEN 'NXDOMAIN' WHEN k % 6 = 2 THEN '' ELSE 'NOERROR' END AS rc,
    {_pick(('TLSv12', 'TLSv10', 'SSLv3'))} AS ver, {_pick(('ok', 'self signed certificate', '', 'certificate expired'))} AS vs,
    {_pick(('text/html', 'application/x-dosexec', 'application/x-elf', 'image/png'))} AS mime, CASE k % 5 WHEN 0 THEN 'a.EXE' WHEN 1 THEN 'b.pdf' ELSE '' END AS fn,
    k * 2000000 AS tb FROM log_events),
  cn AS (SELECT *, op IN {net.SENSOR_PORTS} OR rp IN {net.SENSOR_PORTS} AS odd FROM z)"""
ROW = "row_ AS event_id"


def _shown(df, *more):
    return df.withColumn("suspicious", F.array_join("suspicious", ",")).select(*more, "severity", "suspicious")


@query(
    "sensor_conn",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + """ SELECT uid, at_s, st AS conn_state, op AS source_port, k * 10 AS orig_bytes, CASE WHEN odd OR st IN ('REJ', 'RSTR', 'RSTOS0', 'RSTRH') THEN 'warning' ELSE 'info' END AS severity,
        CASE WHEN odd THEN 'suspicious_port' ELSE '' END AS suspicious FROM cn""",
    ),
)
def sensor_conn(spark, sf_dir):
    found = zeek.conn(sensor_rows(spark, sf_dir)).withColumn("at_s", F.unix_seconds("ts"))
    return _shown(found, "uid", "at_s", "conn_state", "source_port", "orig_bytes")


@query(
    "sensor_http",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + f""", h AS (SELECT *, concat_ws(',', nullif({s.matched('uri', txt.URI_ATTACK_PATTERNS)}, ''), CASE WHEN usr <> '' THEN 'credentials_exposed' END) AS sus FROM z)
        SELECT uid, at_s, uri, code AS status_code, CASE WHEN usr <> '' THEN 'high' WHEN sus <> '' THEN 'warning' WHEN code >= 500 THEN 'error' WHEN code >= 400 THEN 'warning' ELSE 'info' END AS severity,
        sus AS suspicious FROM h""",
    ),
)
def sensor_http(spark, sf_dir):
    found = zeek.http(sensor_rows(spark, sf_dir)).withColumn("at_s", F.unix_seconds("ts"))
    return _shown(found, "uid", "at_s", "uri", "status_code")


@query(
    "sensor_dns",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + f""", l AS (SELECT *, string_split(qn, '.')[-2] AS label FROM z), v AS (SELECT *, {count_chars_sql('label', 'aeiou')} AS vw, len(list_distinct(string_split(label, ''))) AS uq FROM l),
        d AS (SELECT *, coalesce(length(label) BETWEEN 5 AND 20 AND (vw = 0 OR (length(label) - vw) / vw > 4 OR uq / length(label) > 0.8), false) AS dga, ends_with(qn, '.tk') AS bad FROM v)
        SELECT uid, at_s, qn AS query, CASE WHEN dga OR bad OR rc NOT IN ('', 'NOERROR') THEN 'warning' ELSE 'info' END AS severity,
        CASE WHEN dga THEN 'possible_dga' WHEN bad THEN 'suspicious_tld' ELSE '' END AS suspicious FROM d""",
    ),
)
def sensor_dns(spark, sf_dir):
    return _shown(zeek.dns(sensor_rows(spark, sf_dir)).withColumn("at_s", F.unix_seconds("ts")), "uid", "at_s", "query")


@query(
    "sensor_tls",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + """ SELECT uid, at_s, ver AS version, CASE WHEN vs NOT IN ('', 'ok') THEN 'high' WHEN ver IN ('SSLv2', 'SSLv3', 'TLSv10', 'TLSv11') THEN 'warning' ELSE 'info' END AS severity,
        concat_ws(',', CASE WHEN ver IN ('SSLv3', 'TLSv10') THEN 'weak_tls_version' END, CASE WHEN contains(vs, 'self signed') THEN 'self_signed_cert' END,
          CASE WHEN vs NOT IN ('', 'ok') THEN 'cert_validation_failed' END) AS suspicious FROM z""",
    ),
)
def sensor_tls(spark, sf_dir):
    return _shown(zeek.tls(sensor_rows(spark, sf_dir)).withColumn("at_s", F.unix_seconds("ts")), "uid", "at_s", "version")


@query(
    "sensor_files",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + """, f AS (SELECT *, concat_ws(',', CASE WHEN mime IN ('application/x-dosexec', 'application/x-elf') THEN 'executable_file' END, CASE WHEN fn = 'a.EXE' THEN 'suspicious_extension' END,
          CASE WHEN tb > 104857600 THEN 'large_file_transfer' END) AS sus FROM z)
        SELECT 'F' || event_id AS fuid, mime AS mime_type, CASE WHEN sus <> '' THEN 'warning' ELSE 'info' END AS severity, sus AS suspicious FROM f""",
    ),
)
def sensor_files(spark, sf_dir):
    return _shown(zeek.files(sensor_rows(spark, sf_dir)), "fuid", "mime_type")


@query(
    "sensor_notice",
    s.with_ctes("log_events", SENSOR_SQL + " SELECT uid, at_s, '10.9.9.9' AS source_ip, k AS source_port, '10.8.8.8' AS dest_ip, 'high' AS severity FROM z"),
)
def sensor_notice(spark, sf_dir):
    found = zeek.notice(sensor_rows(spark, sf_dir)).withColumn("at_s", F.unix_seconds("ts"))
    return found.select("uid", "at_s", "source_ip", "source_port", "dest_ip", "severity")


UID_SQL = SENSOR_SQL + """, ev AS (SELECT uid, at_s, 'connection' AS log_type, k * 30 AS b, odd AS bad FROM cn UNION ALL
    SELECT uid, at_s, 'notice', 0, true FROM z WHERE st IN ('REJ', 'RSTR', 'RSTOS0')),
  uc AS (SELECT uid, count(*) AS event_count, string_agg(DISTINCT log_type, ',' ORDER BY log_type) AS log_types, CAST(max(at_s) - min(at_s) AS DOUBLE) AS duration,
     CAST(sum(b) AS BIGINT) AS total_bytes, bool_or(bad) AS has_threat FROM ev GROUP BY 1 HAVING count(*) > 1)"""


def mixed_events(spark, sf_dir):
    rows = sensor_rows(spark, sf_dir)
    shared = ["log_type", "uid", "ts", "source_ip", "dest_ip", "severity", "suspicious"]
    notices = zeek.notice(rows.where(F.col("note").isNotNull() & F.col("conn_state").isin("REJ", "RSTR", "RSTOS0")))  # of connections that failed
    return zeek.conn(rows).select(*shared, "orig_bytes", "resp_bytes").unionByName(notices.select(*shared), allowMissingColumns=True)


@query("sensor_uid_correlation", s.with_ctes("log_events", UID_SQL + " SELECT * FROM uc"))
def sensor_uid_correlation(spark, sf_dir):
    return traffic.uid_correlation(mixed_events(spark, sf_dir)).withColumn("log_types", F.array_join("log_types", ","))


@query(
    "sensor_events_with_correlation",
    s.with_ctes("log_events", UID_SQL + " SELECT uid, at_s, log_type, coalesce(event_count, 0) AS event_count FROM ev LEFT JOIN uc USING (uid)".replace("log_type, coalesce", "ev.log_type, coalesce")),
)
def sensor_events_with_correlation(spark, sf_dir):
    events = mixed_events(spark, sf_dir)
    found = traffic.with_correlation(events, traffic.uid_correlation(events))
    return found.select("uid", F.unix_seconds("ts").alias("at_s"), "log_type", F.coalesce("correlation.event_count", F.lit(0)).alias("event_count"))


@query(
    "sensor_hourly_timeline",
    "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS hour_s, count(*) AS events FROM events GROUP BY 1",
)
def sensor_hourly_timeline(spark, sf_dir):
    found = traffic.hourly_timeline(zeek.conn(sensor_rows(spark, sf_dir)))
    return found.select(F.unix_seconds("hour").alias("hour_s"), "events")


@query(
    "sensor_suspicious_rate",
    s.with_ctes("log_events", SENSOR_SQL + " SELECT count(*) AS events, count(*) FILTER (odd) AS suspicious_events, round(count(*) FILTER (odd) * 100 / count(*), 6) AS suspicious_rate FROM cn"),
)
def sensor_suspicious_rate(spark, sf_dir):
    return rounded(traffic.suspicious_rate(zeek.conn(sensor_rows(spark, sf_dir))))


@query(
    "sensor_statistics",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + """, u AS (SELECT 'conn_state' AS facet, st AS value FROM z UNION ALL SELECT 'service', CASE WHEN k % 2 = 0 THEN 'http' ELSE '' END FROM z UNION ALL SELECT 'source_ip', '10.0.0.' || k FROM z),
        c AS (SELECT facet, value, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM c) SELECT facet, value, n FROM r WHERE rn <= 20""",
    ),
)
def sensor_statistics(spark, sf_dir):
    return traffic.top_counts(zeek.conn(sensor_rows(spark, sf_dir)), ["conn_state", "service", "source_ip"], limit=20)


@query(
    "sensor_iocs",
    s.with_ctes(
        "log_events",
        SENSOR_SQL + f""", h AS (SELECT *, {s.matched('uri', txt.URI_ATTACK_PATTERNS)} <> '' OR usr <> '' AS sus FROM z)
        SELECT uid, event_id, 'domain' AS ioc_type, 'h' AS ioc_value, CASE WHEN sus THEN 'high' ELSE 'medium' END AS confidence FROM h
        UNION ALL SELECT uid, event_id, 'url', 'http://h' || uri, 'high' FROM h WHERE sus
        UNION ALL SELECT uid, event_id, 'ip', '8.8.4.' || (k % 9), 'high' FROM h""",
    ),
)
def sensor_iocs(spark, sf_dir):
    from logsieve.operators.ioc import sensor_iocs as extract

    rows = sensor_rows(spark, sf_dir).withColumn("id.resp_h", F.replace("`id.resp_h`", F.lit("203.0.113."), F.lit("8.8.4.")))
    # the second of a row and its uid name the row
    events = zeek.http(rows.withColumn("referrer", F.col("row").cast("string")))
    found = extract(events.withColumn("event_id", F.col("referrer").cast("long")), ["uid", "event_id"])
    return found

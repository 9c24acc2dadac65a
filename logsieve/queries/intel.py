"""Feeds and reputation reports joined to indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import intel, ioc, networks
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

PUBLIC_SQL = """, i AS (SELECT entry_id, file_id, 'ips' AS ioc_type, unnest(regexp_extract_all(message, '203\\.0\\.113\\.\\d+')) AS ioc_value FROM messages
    UNION ALL SELECT entry_id, file_id, 'domains', 'c2.evil.com' FROM messages WHERE contains(message, 'c2.evil.com')),
  feed AS (SELECT 'ips' AS ioc_type, '203.0.113.' || s_suppkey AS ioc_value, CASE s_nationkey % 3 WHEN 0 THEN 'known_malicious'
      WHEN 1 THEN 'tor_exit' ELSE 'vpn' END AS threat_type, CASE s_nationkey % 3 WHEN 0 THEN 'blacklist' ELSE 'anonymizer' END AS tag FROM supplier
    UNION ALL SELECT 'domains', 'c2.evil.com', 'known_malicious', 'blacklist')""".replace("\\\\", "\\")


def feed(spark, sf_dir):
    slot = F.col("s_nationkey") % 3
    listed = adapt.table(spark, sf_dir, "supplier").select(
        F.lit("ips").alias("ioc_type"),
        F.concat(F.lit("203.0.113."), F.col("s_suppkey").cast("string")).alias("ioc_value"),
        F.when(slot == 0, "known_malicious").when(slot == 1, "tor_exit").otherwise("vpn").alias("threat_type"),
        F.when(slot == 0, "blacklist").otherwise("anonymizer").alias("tag"),
    )
    one = spark.range(1).select(
        F.lit("domains").alias("ioc_type"), F.lit("c2.evil.com").alias("ioc_value"),
        F.lit("known_malicious").alias("threat_type"), F.lit("blacklist").alias("tag"),
    )
    return listed.union(one)


def indicators(spark, sf_dir):
    found = ioc.extract_iocs(adapt.messages(spark, sf_dir))
    return found.where(
        ((F.col("ioc_type") == "ips") & F.col("ioc_value").startswith("203.0.113."))
        | ((F.col("ioc_type") == "domains") & (F.col("ioc_value") == "c2.evil.com"))
    )


@query(
    "match_feed",
    s.with_ctes(
        "messages",
        PUBLIC_SQL + """, v AS (SELECT ioc_type, ioc_value, count(*) AS mentions FROM i GROUP BY 1, 2)
        SELECT v.ioc_type, v.ioc_value, mentions, string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS threat_types,
        string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, 0.95 AS confidence, 80 AS threat_score
        FROM v JOIN feed f ON v.ioc_type = f.ioc_type AND v.ioc_value = f.ioc_value GROUP BY 1, 2, 3""",
    ),
)
def match_feed(spark, sf_dir):
    found = intel.match_feed(indicators(spark, sf_dir), feed(spark, sf_dir))
    return found.withColumns({"threat_types": F.array_join("threat_types", ","), "tags": F.array_join("tags", ",")})


@query(
    "entries_matching_feed",
    s.with_ctes(
        "messages",
        PUBLIC_SQL + """ SELECT DISTINCT entry_id FROM i WHERE (ioc_type, ioc_value) IN (SELECT ioc_type, ioc_value FROM feed)""",
    ),
)
def entries_matching_feed(spark, sf_dir):
    return intel.entries_matching_feed(indicators(spark, sf_dir), feed(spark, sf_dir)).select("entry_id").distinct()


REPORTS_SQL = """WITH r AS (SELECT 'ip' AS ioc_type, '203.0.113.' || l_suppkey AS ioc_value, 'src_' || l_linenumber AS source,
    l_discount >= 0.05 AS is_malicious, l_tax * 10 AS confidence, CAST(l_quantity * 2 AS INTEGER) AS threat_score,
    [l_returnflag, l_linestatus] AS threat_types, [l_returnflag] AS tags, l_shipdate AS report_ts,
    CAST(l_quantity % 9 AS INTEGER) AS malicious, CAST(l_linenumber % 4 AS INTEGER) AS suspicious, 20 AS harmless,
    CAST(l_partkey % 30 AS INTEGER) AS undetected, CAST(l_partkey % 140 - 70 AS INTEGER) AS reputation,
    CASE l_orderkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'url' WHEN 2 THEN 'ip' ELSE 'domain' END AS resource_type,
    CASE WHEN l_partkey % 17 = 0 THEN 'Phishing site' ELSE 'news' END AS categories, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""


def reports(spark, sf_dir):
    c = F.col
    return adapt.table(spark, sf_dir, "lineitem").select(
        F.lit("ip").alias("ioc_type"),
        F.concat(F.lit("203.0.113."), c("l_suppkey").cast("string")).alias("ioc_value"),
        F.concat(F.lit("src_"), c("l_linenumber").cast("string")).alias("source"),
        (c("l_discount") >= 0.05).alias("is_malicious"),
        (c("l_tax") * 10).alias("confidence"),
        (c("l_quantity") * 2).cast("int").alias("threat_score"),
        F.array("l_returnflag", "l_linestatus").alias("threat_types"),
        F.array("l_returnflag").alias("tags"),
        c("l_shipdate").cast("timestamp").alias("report_ts"),
        (c("l_quantity") % 9).cast("int").alias("malicious"),
        (c("l_linenumber") % 4).cast("int").alias("suspicious"),
        F.lit(20).alias("harmless"),
        (c("l_partkey") % 30).cast("int").alias("undetected"),
        (c("l_partkey") % 140 - 70).cast("int").alias("reputation"),
        F.when(c("l_orderkey") % 4 == 0, "file").when(c("l_orderkey") % 4 == 1, "url").when(c("l_orderkey") % 4 == 2, "ip")
        .otherwise("domain").alias("resource_type"),
        F.when(c("l_partkey") % 17 == 0, "Phishing site").otherwise("news").alias("categories"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


CONTEXT_SQL = REPORTS_SQL + """, k AS (SELECT ioc_type, ioc_value, count(*) AS reports, count(DISTINCT source) AS sources,
      count(*) FILTER (is_malicious) AS malicious_reports, bool_or(is_malicious) AS is_malicious, max(threat_score) AS max_threat_score,
      avg(confidence) AS average_confidence, array_to_string(list_sort(list_distinct(flatten(list(threat_types)))), ',') AS threat_types,
      array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM r GROUP BY 1, 2)"""


@query(
    "ioc_context",
    CONTEXT_SQL + """ SELECT ioc_type, ioc_value, reports, sources, malicious_reports, is_malicious, max_threat_score,
    round(average_confidence, 6) AS average_confidence, threat_types, tags FROM k""",
)
def ioc_context(spark, sf_dir):
    found = intel.ioc_context(reports(spark, sf_dir)).drop("source_scores")
    return rounded(found.withColumns({"threat_types": F.array_join("threat_types", ","), "tags": F.array_join("tags", ",")}))


@query(
    "ioc_verdicts",
    CONTEXT_SQL + """ SELECT ioc_value, CASE WHEN malicious_reports / reports >= 0.7 THEN 'malicious'
      WHEN malicious_reports / reports >= 0.3 THEN 'suspicious' ELSE 'clean' END AS verdict,
      CASE WHEN malicious_reports / reports >= 0.7 THEN 3 WHEN malicious_reports / reports >= 0.3 THEN 2 ELSE 0 END AS n_advice FROM k""",
)
def ioc_verdicts(spark, sf_dir):
    found = intel.verdicts(intel.ioc_context(reports(spark, sf_dir)))
    return found.select("ioc_value", "verdict", F.size("advice").alias("n_advice"))


RATE = "(malicious + suspicious) / (malicious + suspicious + harmless + undetected) * 100"
SEVERITY_SQL = f"""CASE resource_type
    WHEN 'file' THEN CASE WHEN {RATE} > 50 OR reputation < -50 THEN 'critical' WHEN {RATE} > 25 OR reputation < -20 THEN 'high'
       WHEN {RATE} > 10 OR reputation < 0 THEN 'medium' WHEN {RATE} > 0 THEN 'low' ELSE 'clean' END
    WHEN 'url' THEN CASE WHEN {RATE} > 30 OR regexp_matches(lower(categories), 'phishing|malware|malicious') THEN 'critical' WHEN {RATE} > 15 THEN 'high'
       WHEN {RATE} > 5 THEN 'medium' WHEN {RATE} > 0 THEN 'low' ELSE 'clean' END
    ELSE CASE WHEN malicious > 5 OR reputation < -50 THEN 'critical' WHEN malicious > 2 OR reputation < -20 THEN 'high'
       WHEN malicious > 0 OR reputation < 0 THEN 'medium' ELSE 'clean' END END"""


@query(
    "report_severity",
    REPORTS_SQL + f" SELECT l_orderkey, l_linenumber, l_partkey, resource_type, round({RATE}, 6) AS detection_rate, {SEVERITY_SQL} AS severity FROM r",
)
def report_severity(spark, sf_dir):
    found = intel.report_severity(reports(spark, sf_dir))
    return rounded(found.select("l_orderkey", "l_linenumber", "l_partkey", "resource_type", "detection_rate", "severity"))


@query(
    "reputation_stats",
    REPORTS_SQL + """ SELECT resource_type, count(*) AS total, count(*) FILTER (malicious > 0) AS malicious_count,
    count(*) FILTER (malicious = 0 AND suspicious > 0) AS suspicious_count, count(*) FILTER (malicious + suspicious = 0) AS clean_count,
    round(coalesce(avg(malicious + suspicious) FILTER (malicious + suspicious > 0), 0), 6) AS avg_positives FROM r GROUP BY 1""",
)
def reputation_stats(spark, sf_dir):
    return rounded(intel.reputation_stats(reports(spark, sf_dir)))


ENGINE_SQL = """, e AS (SELECT doc_id, unnest(['Trojan.' || lang, CASE WHEN doc_id % 3 = 0 THEN 'Worm.' || source END, CASE WHEN doc_id % 2 = 0 THEN 'malicious' END]) AS threat FROM documents)"""


def engine_reports(spark, sf_dir):
    return adapt.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.create_map(
            F.lit("engine_a"), F.concat(F.lit("Trojan."), F.col("lang")),
            F.lit("engine_b"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Worm."), F.col("source"))),
            F.lit("engine_c"), F.when(F.col("doc_id") % 2 == 0, "malicious"),
        ).alias("results"),
    )


@query(
    "top_threats",
    "WITH a AS (SELECT 1)" + ENGINE_SQL + " SELECT threat, count(*) AS n FROM e WHERE threat IS NOT NULL GROUP BY 1 ORDER BY n DESC, threat LIMIT 10",
)
def top_threats(spark, sf_dir):
    return intel.top_threats(engine_reports(spark, sf_dir))


@query(
    "threat_names",
    "WITH a AS (SELECT 1)" + ENGINE_SQL + """ SELECT doc_id, string_agg(DISTINCT threat, ',' ORDER BY threat) AS threat_names FROM e
    WHERE threat IS NOT NULL AND threat <> 'malicious' GROUP BY 1""",
)
def threat_names(spark, sf_dir):
    found = intel.threat_names(engine_reports(spark, sf_dir), ["doc_id"])
    return found.withColumn("threat_names", F.array_join("threat_names", ","))


@query(
    "dns_pivot",
    """WITH r AS (SELECT DISTINCT l_suppkey, CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'MX' WHEN 3 THEN 'TXT' ELSE 'CNAME' END AS type,
        'v' || (l_partkey % 20) AS value FROM lineitem)
    SELECT l_suppkey, coalesce(string_agg(value, ',' ORDER BY value) FILTER (type = 'A'), '') AS a,
      coalesce(string_agg(value, ',' ORDER BY value) FILTER (type = 'MX'), '') AS mx,
      coalesce(string_agg(value, ',' ORDER BY value) FILTER (type = 'TXT'), '') AS txt FROM r WHERE type <> 'CNAME' GROUP BY 1""",
)
def dns_pivot(spark, sf_dir):
    n = F.col("l_linenumber")
    records = adapt.table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(n == 1, "A").when(n == 2, "MX").when(n == 3, "TXT").otherwise("CNAME").alias("type"),
        F.concat(F.lit("v"), (F.col("l_partkey") % 20).cast("string")).alias("value"),
    )
    wide = intel.dns_pivot(records, ["l_suppkey"])
    shown = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return wide.select("l_suppkey", shown("A").alias("a"), shown("MX").alias("mx"), shown("TXT").alias("txt"))


@query(
    "behaviour_iocs",
    """SELECT DISTINCT doc_id, 'network' AS section, '203.0.113.' || (doc_id % 9) AS ioc_value FROM documents
    UNION ALL SELECT DISTINCT doc_id, 'files', source || '.tmp' FROM documents UNION ALL SELECT DISTINCT doc_id, 'files', lang FROM documents""",
)
def behaviour_iocs(spark, sf_dir):
    reports_ = adapt.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array(F.concat(F.lit("203.0.113."), (F.col("doc_id") % 9).cast("string"))).alias("network"),
        F.array(F.concat("source", F.lit(".tmp")), F.col("lang")).alias("files"),
    )
    return intel.behaviour_iocs(reports_, ["doc_id"], ["network", "files"])


@query(
    "lookup_reputation",
    REPORTS_SQL + """, n AS (SELECT ioc_value, max(epoch_us(report_ts)) // 1000000 AS report_s FROM r WHERE ioc_type = 'ip' GROUP BY 1),
    want AS (SELECT DISTINCT '203.0.113.' || c_nationkey AS ioc_value FROM customer UNION SELECT '198.51.100.' || c_nationkey FROM customer)
    SELECT ioc_value, CASE WHEN report_s >= epoch_us(TIMESTAMP '2001-10-15') // 1000000 - 5184000 THEN 'known' ELSE 'unknown' END AS status
    FROM want LEFT JOIN n USING (ioc_value)""",
)
def lookup_reputation(spark, sf_dir):
    keys = adapt.table(spark, sf_dir, "customer").select(
        F.lit("ip").alias("ioc_type"),
        F.explode(
            F.array(*[F.concat(F.lit(p), F.col("c_nationkey").cast("string")) for p in ("203.0.113.", "198.51.100.")])
        ).alias("ioc_value"),
    )
    as_of = F.lit("2001-10-15").cast("timestamp")
    found = intel.lookup_reputation(keys, reports(spark, sf_dir), as_of, 5_184_000)
    return found.select("ioc_value", "status")


@query(
    "network_match",
    """WITH a AS (SELECT event_id, (10::BIGINT << 24) + (user_id % 5 << 16) + (event_id % 7 << 8) + event_id % 256 AS num FROM events),
    n AS (SELECT s_suppkey, 8 + s_suppkey * 5 % 25 AS len, (10::BIGINT << 24) + (s_suppkey % 6 << 16) + (s_suppkey % 9 << 8) + s_suppkey % 256 AS num FROM supplier)
    SELECT event_id, s_suppkey, len AS prefix_length FROM a JOIN n ON a.num >> (32 - len) = n.num >> (32 - len)
    QUALIFY rank() OVER (PARTITION BY event_id ORDER BY len DESC) = 1""",
)
def network_match(spark, sf_dir):
    """Addresses of events in the networks of suppliers."""
    st = lambda c: c.cast("string")
    key = F.col("s_suppkey")
    nets = adapt.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("10."), st(key % 6), F.lit("."), st(key % 9), F.lit("."), st(key % 256), F.lit("/"), st(8 + key * 5 % 25)).alias("network")
    )
    addresses = adapt.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("10."), st(F.col("user_id") % 5), F.lit("."), st(F.col("event_id") % 7), F.lit("."), st(F.col("event_id") % 256)).alias("address")
    )
    return networks.network_match(addresses, nets, "address").select("event_id", "s_suppkey", F.col("prefix_length").cast("long").alias("prefix_length"))

"""Indicator extraction over log lines, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import net, text
from logsieve.operators import ioc
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query
from logsieve.queries.scalars import PHISHY_SQL, URL_PARTS_SQL, URLS_SQL, chars_cte, count_chars_sql, made_urls, phishy

KEEP = ["entry_id", "file_id"]
BASIC_SQL = (
    f", {s.CORPUS_TEXTS}, raw AS ("
    + s.find_all("c", ioc.BASIC_PATTERNS, KEEP, guarded="g")
    + """), basic AS (SELECT entry_id, file_id, kind AS ioc_type, ioc_value FROM raw
    WHERE NOT (kind = 'domains' AND regexp_matches(ioc_value, '\\.(log|txt|json|xml)$')))""".replace("\\\\", "\\")
)
ASCII_ONLY = "regexp_matches(ioc_value, '^[\\x00-\\x5E\\x60-\\x7F]*$')"


@query(
    "extract_iocs",
    s.with_ctes(
        "corpus",
        BASIC_SQL + " SELECT file_id, ioc_type, ioc_value, count(*) AS mentions FROM basic GROUP BY 1, 2, 3",
    ),
    also="extract_iocs_whole",
)
def extract_iocs(spark, sf_dir):
    return ioc.distinct_iocs(ioc.extract_iocs(adapt.corpus(spark, sf_dir)))


@query(
    "extract_file_paths",
    s.with_ctes("corpus", BASIC_SQL + " SELECT entry_id, ioc_value FROM basic WHERE ioc_type = 'files'"),
    also="extract_file_paths_whole",
)
def extract_file_paths(spark, sf_dir):
    return ioc.extract_iocs(adapt.corpus(spark, sf_dir), kinds=["files"]).select("entry_id", "ioc_value")


def _ends(column, endings):
    return "(" + " OR ".join(f"ends_with({column}, {s.text(e)})" for e in endings) + ")"


def _valid_domain(d):
    registered = f"CASE WHEN contains({d}, '.') THEN array_to_string(list_slice(string_split(lower({d}), '.'), -2, -1), '.') ELSE lower({d}) END"
    listed = ", ".join(s.text(x) for x in ioc.WHITELIST_DOMAINS)
    return f"(length({d}) >= 4 AND contains({d}, '.') AND NOT {_ends(d, ioc.WHITELIST_ENDINGS)} AND {registered} NOT IN ({listed}))"


def _in_networks(networks):
    return "(" + " OR ".join("num BETWEEN {} AND {}".format(*net._cidr_bounds(n)) for n in networks) + ")"


HOST = r"regexp_replace(lower(regexp_extract(ioc_value, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '')"
NUM = (
    f"CASE WHEN regexp_matches(ioc_value, {s.text(net.IPV4)}) THEN CAST(split_part(ioc_value,'.',1) AS BIGINT)*16777216 + "
    "CAST(split_part(ioc_value,'.',2) AS BIGINT)*65536 + CAST(split_part(ioc_value,'.',3) AS BIGINT)*256 + "
    "CAST(split_part(ioc_value,'.',4) AS BIGINT) END"
)
VALID_SQL = f"""CASE
    WHEN kind IN ('ipv4', 'ipv6') THEN (num IS NOT NULL OR regexp_matches(ioc_value, {s.text(net.IPV6)}))
      AND NOT coalesce({_in_networks(net.PRIVATE_NETWORKS)}, false)
      AND NOT (num IS NULL AND regexp_matches(lower(ioc_value), '^(::1$|::$|f[cd][0-9a-f]{{2}}:|fe[89ab][0-9a-f]:)'))
      AND ioc_value NOT IN ({', '.join(s.text(x) for x in ioc.WHITELIST_IPS)})
    WHEN kind IN ('domain', 'subdomain') THEN {_valid_domain('ioc_value')}
    WHEN kind = 'url' THEN {_valid_domain(HOST)}
    WHEN kind = 'email' THEN {_valid_domain("split_part(ioc_value, '@', 2)")} AND length(regexp_replace(ioc_value, '[^@]', '', 'g')) = 1
    WHEN kind IN ('md5', 'sha1', 'sha256', 'sha512') THEN ioc_value NOT IN ({', '.join(s.text(x) for x in ioc.EMPTY_FILE_HASHES)})
    WHEN kind = 'windows_path' THEN length(ioc_value) > 3
    WHEN kind = 'unix_path' THEN length(ioc_value) > 1 AND NOT regexp_matches(ioc_value, '^/+$')
    WHEN kind = 'bitcoin' THEN length(ioc_value) BETWEEN 26 AND 35
    WHEN kind = 'base64' THEN length(ioc_value) >= 40 ELSE true END"""


def advanced_sql(source: str, patterns=ioc.ADVANCED_PATTERNS) -> str:
    texts = s.CORPUS_TEXTS if source == "corpus" else f"c AS (SELECT entry_id, file_id, message AS t, message AS g FROM {source})"
    return (
        f", {texts}, raw AS ("
        + s.find_all("c", patterns, KEEP, ioc.LOWERED, "g")
        + f"), numbered AS (SELECT *, {NUM} AS num FROM raw), advanced AS (SELECT entry_id, file_id, kind, ioc_value FROM numbered WHERE {VALID_SQL})"
    )


@query(
    "extract_advanced",
    s.with_ctes("messages", advanced_sql("messages") + " SELECT entry_id, kind, ioc_value FROM advanced"),
)
def extract_advanced(spark, sf_dir):
    return ioc.extract_advanced(adapt.messages(spark, sf_dir)).select("entry_id", "kind", "ioc_value")


@query(
    "extract_advanced_corpus",
    s.with_ctes("corpus", advanced_sql("corpus") + " SELECT kind, ioc_value, count(*) AS entries FROM advanced GROUP BY 1, 2"),
    also="extract_advanced_whole",
)
def extract_advanced_corpus(spark, sf_dir):
    found = ioc.extract_advanced(adapt.corpus(spark, sf_dir))
    return found.groupBy("kind", "ioc_value").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "extract_more_kinds",
    s.with_ctes("corpus", advanced_sql("corpus", ioc.MORE_PATTERNS) + " SELECT kind, ioc_value, count(*) AS entries FROM advanced GROUP BY 1, 2"),
)
def extract_more_kinds(spark, sf_dir):
    """Sub-domains and two more currencies."""
    found = ioc.extract_advanced(adapt.corpus(spark, sf_dir), patterns=ioc.MORE_PATTERNS)
    return found.groupBy("kind", "ioc_value").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "ioc_whitelist",
    s.with_ctes(
        "messages",
        advanced_sql("messages") + """, w AS (SELECT DISTINCT '203.0.113.' || s_suppkey AS v FROM supplier UNION SELECT 'c2.evil.com')
        SELECT kind, ioc_value, count(*) AS n FROM advanced WHERE kind IN ('ipv4', 'domain', 'email') AND ioc_value NOT IN (SELECT v FROM w)
        GROUP BY 1, 2""",
    ),
)
def ioc_whitelist(spark, sf_dir):
    known = adapt.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("203.0.113."), F.col("s_suppkey").cast("string")).alias("ioc_value")
    ).union(spark.range(1).select(F.lit("c2.evil.com").alias("ioc_value")))
    found = ioc.extract_advanced(adapt.messages(spark, sf_dir), whitelist=known)
    return found.where("kind IN ('ipv4', 'domain', 'email')").groupBy("kind", "ioc_value").agg(F.count(F.lit(1)).alias("n"))


HASH_KINDS = ("md5", "sha1", "sha256", "sha512")
CONTEXT_SQL = (
    ", c AS (SELECT entry_id, file_id, message AS t FROM messages), raw AS ("
    + s.find_all("c", {k: ioc.ADVANCED_PATTERNS[k] for k in HASH_KINDS}, KEEP)
    + """), ctx AS (SELECT c.entry_id, c.file_id, kind, lower(ioc_value) AS ioc_value,
      substr(t, greatest(position(ioc_value IN t) - 50, 1),
         position(ioc_value IN t) + length(ioc_value) + 50 - greatest(position(ioc_value IN t) - 50, 1)) AS context
      FROM raw JOIN c USING (entry_id) WHERE lower(ioc_value) NOT IN """
    + str(ioc.EMPTY_FILE_HASHES) + ")"
)


@query(
    "hash_contexts",
    s.with_ctes("messages", CONTEXT_SQL + " SELECT entry_id, kind, ioc_value, context FROM ctx"),
)
def hash_contexts(spark, sf_dir):
    return ioc.hash_contexts(adapt.messages(spark, sf_dir))


@query(
    "file_hash_links",
    s.with_ctes(
        "messages",
        CONTEXT_SQL + ", paths AS ("
        + s.find_all("c", {k: ioc.ADVANCED_PATTERNS[k] for k in ("windows_path", "unix_path")}, KEEP)
        + r"""), names AS (SELECT DISTINCT file_id, lower(CASE WHEN contains(ioc_value, '\') THEN string_split(ioc_value, '\')[-1]
            ELSE string_split(ioc_value, '/')[-1] END) AS file_name FROM paths
          WHERE (kind = 'windows_path' AND length(ioc_value) > 3) OR (kind = 'unix_path' AND length(ioc_value) > 1 AND NOT regexp_matches(ioc_value, '^/+$')))
        SELECT DISTINCT file_id, file_name, ioc_value AS hash, kind FROM ctx JOIN names USING (file_id)
        WHERE file_name <> '' AND contains(lower(context), file_name)""",
    ),
)
def file_hash_links(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    paths = ioc.extract_advanced(lines).where("ioc_type = 'file_paths'")
    return ioc.file_hash_links(ioc.hash_contexts(lines, keep=["entry_id", "file_id"]), paths)


@query(
    "context_flags",
    s.with_ctes(
        "messages",
        " UNION ALL ".join(
            f"SELECT entry_id, '{n}' AS flag FROM messages WHERE regexp_matches(message, {s.text(p)})"
            for n, p in ioc.CONTEXT_PATTERNS.items()
        ),
    ),
)
def context_flags(spark, sf_dir):
    return ioc.context_flags(adapt.messages(spark, sf_dir))


@query(
    "base64_previews",
    s.with_ctes(
        "messages",
        """, b AS (SELECT entry_id, message, base64(encode(message)) AS v FROM messages)
        SELECT entry_id, CASE WHEN length(v) > 100 THEN left(v, 100) || '...' ELSE v END AS encoded,
          CASE WHEN length(message) > 50 THEN left(message, 50) || '...' ELSE message END AS decoded_preview FROM b WHERE length(v) >= 40""",
    ),
)
def base64_previews(spark, sf_dir):
    encoded = adapt.messages(spark, sf_dir).select(
        "entry_id", text.transform(F.col("message"), "base64").alias("ioc_value")
    )
    return ioc.base64_previews(encoded).select("entry_id", "encoded", "decoded_preview")


@query(
    "ioc_summary",
    s.with_ctes(
        "corpus",
        BASIC_SQL + """ SELECT ioc_type, count(*) AS mentions, count(DISTINCT ioc_value) AS distinct_values,
        count(DISTINCT file_id) AS files FROM basic GROUP BY 1""",
    ),
    also="ioc_summary_whole",
)
def ioc_summary(spark, sf_dir):
    return ioc.ioc_summary(ioc.extract_iocs(adapt.corpus(spark, sf_dir)))


@query(
    "url_intel",
    "WITH a AS (SELECT 1)" + URLS_SQL + f", p AS (SELECT page_id, {URL_PARTS_SQL} FROM u)"
    + f""" SELECT page_id, 'suspicious_port' AS finding, 0.8 AS confidence FROM p WHERE port IN {net.C2_PORTS}
    UNION ALL SELECT page_id, 'webshell_path', 0.9 FROM p WHERE {s.has_any('lower(path)', net.WEBSHELL_PATHS)}""",
)
def url_intel(spark, sf_dir):
    return ioc.url_intel(made_urls(spark, sf_dir)).select("page_id", "finding", "confidence")


@query(
    "domain_verdicts",
    "WITH a AS (SELECT 1)" + PHISHY_SQL + ", l AS (SELECT page_id, domain, split_part(domain, '.', 1) AS word FROM phishy)"
    + chars_cte("(SELECT DISTINCT word FROM l)")
    + f""" SELECT page_id, domain, 'potential_dga' AS threat_type, 0.7 AS confidence FROM l JOIN entropies USING (word)
      WHERE length(word) BETWEEN 8 AND 30 AND bits > 3.5 AND {count_chars_sql('word', text.VOWELS)} / length(word) < 0.3
    UNION ALL SELECT page_id, domain, 'potential_phishing', 0.8 FROM phishy WHERE regexp_matches(domain, {s.text(text.PHISHING_CONTEXT)})""",
)
def domain_verdicts(spark, sf_dir):
    return ioc.domain_verdicts(phishy(spark, sf_dir))


IP_URLS_SQL = r""", m AS (SELECT event_id AS entry_id, user_id AS file_id, 'open http://host' || (user_id % 9) || '.evil.net/go?to=203.0.113.'
      || (event_id % 200) || ' seen host' || (event_id % 9) || '.evil.net and 203.0.113.' || (event_id % 50) AS message FROM events)"""


@query(
    "domain_ip_links",
    "WITH a AS (SELECT 1)" + IP_URLS_SQL + ", c AS (SELECT entry_id, file_id, message AS t FROM m), raw AS ("
    + s.find_all("c", {k: ioc.BASIC_PATTERNS[k] for k in ("ips", "domains", "urls")}, KEEP)
    + f"""), inside AS (SELECT DISTINCT file_id, regexp_extract(ioc_value, '://([^/:?#]+)', 1) AS domain,
          unnest(regexp_extract_all(ioc_value, {s.text(ioc.BASIC_PATTERNS['ips'])})) AS ip FROM raw WHERE kind = 'urls')
    SELECT DISTINCT file_id, ip, domain FROM inside
    WHERE (file_id, ip) IN (SELECT file_id, ioc_value FROM raw WHERE kind = 'ips')
      AND (file_id, domain) IN (SELECT file_id, ioc_value FROM raw WHERE kind = 'domains')""",
)
def domain_ip_links(spark, sf_dir):
    st = lambda c: c.cast("string")
    user, n = F.col("user_id"), F.col("event_id")
    lines = adapt.table(spark, sf_dir, "events").select(
        n.alias("entry_id"),
        user.alias("file_id"),
        F.concat(
            F.lit("open http://host"), st(user % 9), F.lit(".evil.net/go?to=203.0.113."), st(n % 200), F.lit(" seen host"),
            st(n % 9), F.lit(".evil.net and 203.0.113."), st(n % 50),
        ).alias("message"),
    )
    return ioc.domain_ip_links(ioc.extract_iocs(lines))


@query(
    "c2_infrastructure",
    s.with_ctes(
        "messages",
        f""", bad AS (SELECT DISTINCT file_id, CASE k % 20 WHEN 9 THEN 'c2.evil.com' WHEN 12 THEN 'malware-delivery.net' END AS domain FROM messages
            WHERE k % 20 IN (9, 12)),
        ind AS (SELECT file_id, count(*) AS indicators FROM (
            SELECT file_id FROM messages WHERE regexp_matches(message, {s.text(ioc.CONTEXT_PATTERNS['c2_beacon'])}) UNION ALL
            SELECT file_id FROM messages WHERE regexp_matches(message, {s.text(ioc.CONTEXT_PATTERNS['c2_commands'])})) GROUP BY 1)
        SELECT file_id, string_agg(domain, ',' ORDER BY domain) AS domains, indicators FROM bad JOIN ind USING (file_id) GROUP BY 1, 3""",
    ),
)
def c2_infrastructure(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    found = ioc.extract_advanced(lines).where("kind = 'domain'")
    bad = found.where(F.col("ioc_value").isin("c2.evil.com", "malware-delivery.net")).select(
        "file_id", F.col("ioc_value").alias("domain")
    )
    flags = ioc.context_flags(lines, keep=["file_id"]).where(F.col("flag").startswith("c2_"))
    return ioc.c2_infrastructure(bad, flags).withColumn("domains", F.array_join("domains", ","))


@query(
    "entries_with_iocs",
    s.with_ctes(
        "messages",
        f"SELECT entry_id FROM messages WHERE regexp_matches(message, {s.text(ioc.BASIC_PATTERNS['urls'])})",
    ),
)
def entries_with_iocs(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    urls = ioc.extract_iocs(lines).where("ioc_type = 'urls'")
    return ioc.entries_with_iocs(lines, urls).select("entry_id")


AGENTS = ("curl", "Wget", "Mozilla/5.0", "Python-urllib")


@query(
    "suspicious_agents",
    s.with_ctes(
        "messages",
        """, a AS (SELECT entry_id, CASE k % 4 WHEN 0 THEN 'curl' WHEN 1 THEN 'Wget' WHEN 2 THEN 'Mozilla/5.0' ELSE 'Python-urllib' END AS ua FROM messages)
        SELECT entry_id, ua AS user_agent FROM a WHERE ua IN ('curl', 'Wget', 'Python-urllib')""",
    ),
)
def suspicious_agents(spark, sf_dir):
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), F.col("k") % 4 + 1)
    lines = adapt.messages(spark, sf_dir).select(
        "entry_id", F.concat("message", F.lit("\nUser-Agent: "), agent, F.lit("\nAccept: *")).alias("message")
    )
    return ioc.suspicious_agents(lines)


@query(
    "suspicious_attachments",
    s.with_ctes(
        "messages",
        """SELECT entry_id, 'doc' || k || CASE k % 4 WHEN 0 THEN '.exe' WHEN 2 THEN '.ZIP' END AS attachment FROM messages WHERE k % 2 = 0""",
    ),
)
def suspicious_attachments(spark, sf_dir):
    k = F.col("k")
    ending = F.when(k % 4 == 0, ".exe").when(k % 4 == 1, ".pdf").when(k % 4 == 2, ".ZIP").otherwise(".txt")
    lines = adapt.messages(spark, sf_dir).select(
        "entry_id",
        F.concat(F.lit('Content-Disposition: attachment; filename="doc'), k.cast("string"), ending, F.lit('"; size=1')).alias("message"),
    )
    return ioc.suspicious_attachments(lines)


@query(
    "dga_dns_queries",
    s.with_ctes(
        "log_events",
        """, d AS (SELECT event_id, left(md5(CAST(k AS VARCHAR)), 14) AS word FROM log_events WHERE k % 2 = 0)"""
        + chars_cte("(SELECT DISTINCT word FROM d)")
        + f""" SELECT event_id AS entry_id, word || '.info' AS domain, 0.8 AS confidence FROM d JOIN entropies USING (word)
        WHERE bits > 3.5 AND {count_chars_sql('word', text.VOWELS)} / length(word) < 0.3""",
    ),
)
def dga_dns_queries(spark, sf_dir):
    k = F.col("k")
    verb = F.when(k % 2 == 0, "DNS query for ").otherwise("lookup of ")
    lines = adapt.log_events(spark, sf_dir).select(
        F.col("event_id").alias("entry_id"),
        F.concat(verb, F.left(F.md5(k.cast("string")), F.lit(14)), F.lit(".info")).alias("message"),
    )
    return ioc.dga_dns_queries(lines)


@query(
    "cloud_iocs",
    s.with_ctes(
        "log_events",
        r"""SELECT event_id, 'ips' AS ioc_type, '198.51.100.' || k AS ioc_value FROM log_events
        UNION ALL SELECT event_id, 'ips', '10.9.8.' || (k % 30) FROM log_events
        UNION ALL SELECT event_id, 'domains', 'api' || k || '.corp.net' FROM log_events
        UNION ALL SELECT event_id, 'domains', 'bucket' || k || '.s3.amazonaws.com' FROM log_events
        UNION ALL SELECT event_id, 'keys', 'AWS_KEY_AKIA...' || right('0000' || k, 4) FROM log_events""",
    ),
)
def cloud_iocs(spark, sf_dir):
    k = F.col("k").cast("string")
    calls = adapt.log_events(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit("198.51.100."), k).alias("source_ip"),
        F.concat(
            F.lit('{"host":"api'), k, F.lit('.corp.net","peer":"10.9.8.'), (F.col("k") % 30).cast("string"),
            F.lit('","path":"s3://bucket'), k, F.lit('","svc":"ec2.amazonaws.com"}'),
        ).alias("params"),
        F.concat(F.lit("AKIAXX0000"), k).alias("key"),
    )
    return ioc.cloud_iocs(calls, "params", "source_ip", "key", ["event_id"])


@query(
    "flow_iocs",
    s.with_ctes(
        "flows",
        """, i AS (SELECT 'ips' AS ioc_type, CAST(src AS VARCHAR) AS ioc_value FROM flows UNION ALL SELECT 'ips', CAST(dst AS VARCHAR) FROM flows
        UNION ALL SELECT 'domains', 'backdoor-port-' || dst_port FROM flows WHERE dst_port IN (4444, 5555, 6666, 7777, 8888, 9999))
        SELECT ioc_type, ioc_value, count(*) AS n FROM i GROUP BY 1, 2""",
    ),
)
def flow_iocs(spark, sf_dir):
    found = ioc.flow_iocs(adapt.flows(spark, sf_dir), "src", "dst", "dst_port", ["flow_id"])
    return found.groupBy("ioc_type", "ioc_value").agg(F.count(F.lit(1)).alias("n"))


def _variant_sql(name):
    spec = ioc.VARIANTS[name]
    parts = ", c AS (SELECT entry_id, file_id, message AS t FROM messages), raw AS (" + s.find_all("c", spec["patterns"], KEEP, ("emails", "hashes")) + ")"
    local = " OR ".join(f"starts_with(ioc_value, '{p}')" for p in (*ioc.LOCAL_PREFIXES, "0."))
    keep = "true" if spec["local_ips"] else f"NOT (kind = 'ips' AND ({local} OR NOT regexp_matches(ioc_value, {s.text(net.IPV4)})))"
    for ending in spec["skip_endings"]:
        keep += f" AND NOT (kind = 'domains' AND ends_with(ioc_value, '{ending}'))"
    parts += f", vk AS (SELECT entry_id, kind AS ioc_type, ioc_value FROM raw WHERE {keep})"
    body = f"SELECT '{name}' AS variant, ioc_type, ioc_value, count(*) AS n FROM vk GROUP BY 2, 3"
    if spec["domains_of"]:
        kinds = ", ".join(s.text(k) for k in spec["domains_of"])
        host = "CASE ioc_type WHEN 'emails' THEN split_part(ioc_value, '@', 2) ELSE lower(regexp_extract(ioc_value, '^[a-z]+://([^/:?#]+)', 1)) END"
        body = (
            f"SELECT '{name}' AS variant, ioc_type, ioc_value, count(*) AS n FROM (SELECT * FROM vk UNION ALL SELECT DISTINCT entry_id, 'domains', {host} FROM vk"
            f" WHERE ioc_type IN ({kinds})) GROUP BY 2, 3"
        )
    return s.with_ctes("messages", parts + " " + body)


def _register(name):
    @query(f"iocs_of_{name}", _variant_sql(name))
    def variant(spark, sf_dir):
        found = ioc.extract_variant(adapt.messages(spark, sf_dir), name)
        return found.groupBy(F.lit(name).alias("variant"), "ioc_type", "ioc_value").agg(F.count(F.lit(1)).alias("n"))

    return variant


for _name in ioc.VARIANTS:
    _register(_name)

"""Scalar functions and predicates over lines, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import clock, host, net, predicates, text
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query


def joined(col):
    return F.array_join(col, ",")


@query(
    "severity_from_message",
    s.with_ctes("messages", f"SELECT entry_id, {s.first_class('message', text.SEVERITY_WORDS, 'info')} AS severity FROM messages"),
)
def severity_from_message(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select(
        "entry_id", text.severity_from_message(F.col("message")).alias("severity")
    )


def _guess_sql(flavour):
    return s.first_class("message", text.EVENT_TYPE_WORDS[flavour], text.EVENT_TYPE_DEFAULT[flavour])


@query(
    "guess_event_type",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, {_guess_sql('text')} AS text_type, {_guess_sql('json')} AS json_type,
            {_guess_sql('csv')} AS csv_type,
            CASE WHEN {s.first_class('event_type', text.CSV_ACTION_WORDS, '')} <> ''
                 THEN {s.first_class('event_type', text.CSV_ACTION_WORDS, '')} ELSE {_guess_sql('csv')} END AS action_type
            FROM messages""",
    ),
)
def guess_event_type(spark, sf_dir):
    m = F.col("message")
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        text.guess_event_type(m, "text").alias("text_type"),
        text.guess_event_type(m, "json").alias("json_type"),
        text.guess_event_type(m, "csv").alias("csv_type"),
        text.guess_event_type(m, "csv", F.col("event_type")).alias("action_type"),
    )


def _csv_level_sql():
    whens = " ".join(
        f"WHEN lower(event_type) IN ({', '.join(s.text(w) for w in words)}) THEN {s.text(n)}"
        for n, words in text.CSV_LEVEL_NAMES.items()
    )
    return f"CASE {whens} ELSE {s.first_class('message', text.CSV_SEVERITY_WORDS, 'info')} END"


@query(
    "severity_from_object_and_csv",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, {s.first_class('message', text.OBJECT_SEVERITY_WORDS, 'info')} AS object_severity,
            {_csv_level_sql()} AS csv_severity FROM messages""",
    ),
)
def severity_from_object_and_csv(spark, sf_dir):
    m = F.col("message")
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        text.severity_from_object(m).alias("object_severity"),
        text.severity_from_csv(F.col("event_type"), m).alias("csv_severity"),
    )


@query(
    "security_indicators",
    s.with_ctes(
        "messages",
        f""", x AS (SELECT entry_id, message, {s.matched('message', text.SECURITY_PATTERNS)} AS indicators FROM messages)
        SELECT entry_id, indicators, CASE WHEN indicators <> '' THEN 'high'
               ELSE {s.first_class('message', text.SEVERITY_WORDS, 'info')} END AS severity FROM x""",
    ),
)
def security_indicators(spark, sf_dir):
    found = text.security_indicators(F.col("message"))
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        joined(found).alias("indicators"),
        text.lifted_severity(text.severity_from_message(F.col("message")), found).alias("severity"),
    )


@query(
    "web_attack_flags",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, {s.matched('message', text.URI_ATTACK_PATTERNS)} AS uri_flags,
            {s.matched('message', text.WEB_LOG_PATTERNS)} AS web_flags FROM messages""",
    ),
)
def web_attack_flags(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        joined(text.uri_attack_flags(F.col("message"))).alias("uri_flags"),
        joined(text.web_log_flags(F.col("message"))).alias("web_flags"),
    )


def template_sql(column: str) -> str:
    steps = [
        (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", ""),
        (r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "UUID"),
        (r"\d+\.\d+\.\d+\.\d+", "IP"),
        (r"\d+", "NUM"),
    ]
    out = column
    for pattern, by in steps:
        out = f"regexp_replace({out}, {s.text(pattern)}, {s.text(by)}, 'g')"
    return f"substr(trim(lower({out})), 1, 100)"


@query(
    "normalize_message",
    s.with_ctes("messages", f"SELECT {template_sql('message')} AS template, count(*) AS n FROM messages GROUP BY 1"),
)
def normalize_message(spark, sf_dir):
    return (
        adapt.messages(spark, sf_dir)
        .groupBy(text.normalize_message(F.col("message")).alias("template"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "log_pattern",
    s.with_ctes(
        "log_events",
        """SELECT 'type:' || event_type || '|src:' || source || '|action:' || action || '|result:' || result AS pattern,
           count(*) AS n FROM log_events GROUP BY 1""",
    ),
)
def log_pattern(spark, sf_dir):
    fields = {"type": F.col("event_type"), "src": F.col("source"), "action": F.col("action"), "result": F.col("result")}
    return (
        adapt.log_events(spark, sf_dir).groupBy(text.log_pattern(fields).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "is_error",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, {s.has_any('lower(level)', text.ERROR_WORDS)} OR {s.has_any('lower(message)', text.ERROR_WORDS)}
            AS is_error FROM messages""",
    ),
)
def is_error(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select(
        "entry_id", text.is_error(F.col("level"), F.col("message")).alias("is_error")
    )


# distinct line words of the documents: real text of many lengths for the character tests
WORDS_SQL = """, words AS (
    SELECT DISTINCT unnest(string_split_regex(lower(message), '[^A-Za-z0-9]+')) AS word FROM entries)"""


def words(spark, sf_dir):
    lines = adapt.entries(spark, sf_dir)
    return lines.select(F.explode(F.split(F.lower("message"), "[^A-Za-z0-9]+")).alias("word")).distinct()


def chars_cte(source: str = "words", key: str = "word") -> str:
    return f""", chars AS (SELECT {key}, ch, count(*) AS n FROM
        (SELECT {key}, unnest(string_split({key}, '')) AS ch FROM {source} WHERE {key} <> '') GROUP BY 1, 2),
    entropies AS (SELECT {key}, -sum((n / len_) * log2(n / len_)) AS bits FROM
        (SELECT {key}, CAST(n AS DOUBLE) AS n, CAST(length({key}) AS DOUBLE) AS len_ FROM chars) GROUP BY 1)"""


@query(
    "string_entropy",
    s.with_ctes("entries", WORDS_SQL + chars_cte() + " SELECT word, round(bits, 6) AS bits FROM entropies"),
)
def string_entropy(spark, sf_dir):
    return (
        words(spark, sf_dir)
        .where("word <> ''")
        .select("word", F.round(text.string_entropy(F.col("word")), 6).alias("bits"))
    )


def count_chars_sql(column: str, chars: str) -> str:
    return f"(length({column}) - length(translate({column}, {s.text(chars)}, '')))"


DOMAINS_SQL = """, domains AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain FROM pages
    UNION SELECT word || '.net' FROM words WHERE word <> '')"""


def domains(spark, sf_dir):
    hosts = adapt.urls(spark, sf_dir).select(net.url_host(F.col("url")).alias("domain"))
    made = words(spark, sf_dir).where("word <> ''").select(F.concat("word", F.lit(".net")).alias("domain"))
    return hosts.union(made).distinct()


@query(
    "dga_by_entropy",
    s.with_ctes(
        "entries",
        WORDS_SQL + DOMAINS_SQL + ", labels_ AS (SELECT domain, split_part(domain, '.', 1) AS word FROM domains)"
        + chars_cte("(SELECT DISTINCT word FROM labels_)")
        + f""" SELECT domain, coalesce(length(word) BETWEEN 8 AND 30 AND bits > 3.5
               AND {count_chars_sql('word', text.VOWELS)} / length(word) < 0.3, false) AS is_dga
            FROM labels_ LEFT JOIN entropies USING (word)""",
    ),
)
def dga_by_entropy(spark, sf_dir):
    return domains(spark, sf_dir).select("domain", text.is_dga_by_entropy(F.col("domain")).alias("is_dga"))


@query(
    "dga_by_consonants",
    s.with_ctes(
        "entries",
        WORDS_SQL + DOMAINS_SQL
        + f""" SELECT domain, length(domain) > 15 AND
            {count_chars_sql('domain', text.CONSONANTS)} / length(domain) > 0.75 AS is_dga FROM domains""",
    ),
)
def dga_by_consonants(spark, sf_dir):
    return domains(spark, sf_dir).select("domain", text.is_dga_by_consonants(F.col("domain")).alias("is_dga"))


@query(
    "dga_by_label",
    s.with_ctes(
        "entries",
        WORDS_SQL + DOMAINS_SQL
        + f""", parts AS (SELECT domain, string_split(domain, '.') AS p, string_split(domain, '.')[-2] AS label FROM domains),
        v AS (SELECT *, {count_chars_sql('label', text.VOWELS)} AS vowels,
                     len(list_distinct(string_split(label, ''))) AS uniq FROM parts)
        SELECT domain, coalesce(length(label) BETWEEN 5 AND 20 AND (vowels = 0 OR (length(label) - vowels) / vowels > 4
               OR uniq / length(label) > 0.8), false) AS is_dga FROM v""",
    ),
)
def dga_by_label(spark, sf_dir):
    return domains(spark, sf_dir).select("domain", text.is_dga_by_label(F.col("domain")).alias("is_dga"))


PHISHY_SQL = """, hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h, page_id FROM pages),
    phishy AS (SELECT CASE page_id % 4 WHEN 0 THEN 'secure-' || h WHEN 1 THEN 'paypal.com'
        WHEN 2 THEN 'login.' || h || '.update.tk' ELSE h END AS domain, page_id FROM hosts)"""


def phishy(spark, sf_dir):
    host_name = net.url_host(F.col("url"))
    slot = F.col("page_id") % 4
    return adapt.urls(spark, sf_dir).select(
        "page_id",
        F.when(slot == 0, F.concat(F.lit("secure-"), host_name))
        .when(slot == 1, "paypal.com")
        .when(slot == 2, F.concat(F.lit("login."), host_name, F.lit(".update.tk")))
        .otherwise(host_name)
        .alias("domain"),
    )


@query(
    "phishing_domain_tests",
    "WITH a AS (SELECT 1)" + PHISHY_SQL
    + " SELECT page_id, domain, ("
    + " OR ".join(
        f"(contains(lower(domain), {s.text(w)}) AND NOT ends_with(lower(domain), {s.text(w + '.com')}))"
        for w in text.PHISHING_WORDS
    )
    + f") AS is_phishing, regexp_matches(domain, {s.text(text.PHISHING_CONTEXT)}) AS context_hit FROM phishy",
)
def phishing_domain_tests(spark, sf_dir):
    return phishy(spark, sf_dir).select(
        "page_id",
        "domain",
        text.is_phishing_domain(F.col("domain")).alias("is_phishing"),
        text.is_phishing_context(F.col("domain")).alias("context_hit"),
    )


IPS_SQL = """, ips AS (SELECT event_id,
    CASE k % 8 WHEN 0 THEN '10.' || k || '.' || (event_id % 256) || '.1' WHEN 1 THEN '172.' || (k % 40) || '.0.' || k
         WHEN 2 THEN '192.168.' || k || '.7' WHEN 3 THEN '8.8.' || k || '.' || (event_id % 300)
         WHEN 4 THEN '2001:db8::' || k WHEN 5 THEN 'fe80::' || k WHEN 6 THEN '224.0.' || k || '.1'
         ELSE '127.0.0.' || k END AS ip FROM log_events)"""


def ips(spark, sf_dir):
    k, n = F.col("k"), F.col("event_id")
    dotted = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    ks = k.cast("string")
    return adapt.log_events(spark, sf_dir).select(
        "event_id",
        F.when(k % 8 == 0, dotted("10.", ks, ".", (n % 256).cast("string"), ".1"))
        .when(k % 8 == 1, dotted("172.", (k % 40).cast("string"), ".0.", ks))
        .when(k % 8 == 2, dotted("192.168.", ks, ".7"))
        .when(k % 8 == 3, dotted("8.8.", ks, ".", (n % 300).cast("string")))
        .when(k % 8 == 4, dotted("2001:db8::", ks))
        .when(k % 8 == 5, dotted("fe80::", ks))
        .when(k % 8 == 6, dotted("224.0.", ks, ".1"))
        .otherwise(dotted("127.0.0.", ks))
        .alias("ip"),
    )


LONG_SQL = (
    "CASE WHEN is4 THEN CAST(split_part(ip,'.',1) AS BIGINT)*16777216 + CAST(split_part(ip,'.',2) AS BIGINT)*65536"
    " + CAST(split_part(ip,'.',3) AS BIGINT)*256 + CAST(split_part(ip,'.',4) AS BIGINT) END"
)
PARSED_IPS_SQL = IPS_SQL + f""", n4 AS (SELECT *, regexp_matches(ip, {s.text(net.IPV4)}) AS is4 FROM ips),
    nums AS (SELECT *, {LONG_SQL} AS num, regexp_matches(ip, {s.text(net.IPV6)}) AS is6 FROM n4)"""


def _in_networks(networks):
    return "(" + " OR ".join("num BETWEEN {} AND {}".format(*net._cidr_bounds(n)) for n in networks) + ")"


@query(
    "ip_range_tests",
    s.with_ctes(
        "log_events",
        PARSED_IPS_SQL + f""", flags AS (SELECT *, coalesce({_in_networks(net.PRIVATE_NETWORKS)}, false) OR
             (NOT is4 AND regexp_matches(lower(ip), '^(::1$|::$|f[cd][0-9a-f]{{2}}:|fe[89ab][0-9a-f]:)')) AS private FROM nums)
        SELECT event_id, ip, private AS is_private, (is4 OR is6) AND NOT private AS is_public,
               coalesce({_in_networks(['172.16.0.0/12'])}, false) AS in_net FROM flags""",
    ),
)
def ip_range_tests(spark, sf_dir):
    ip = F.col("ip")
    return ips(spark, sf_dir).select(
        "event_id",
        "ip",
        net.is_private_ip(ip).alias("is_private"),
        net.is_public_ip(ip).alias("is_public"),
        net.in_cidr(ip, "172.16.0.0/12").alias("in_net"),
    )


@query(
    "is_external",
    s.with_ctes(
        "log_events",
        IPS_SQL + r""" SELECT event_id, ip, ip <> '' AND NOT regexp_matches(ip, '^10\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.')
        AS external FROM ips""",
    ),
)
def is_external(spark, sf_dir):
    return ips(spark, sf_dir).select("event_id", "ip", net.is_external(F.col("ip")).alias("external"))


@query(
    "ip_domain_enrichment",
    s.with_ctes(
        "log_events",
        PARSED_IPS_SQL + """ SELECT event_id, ip, coalesce(num BETWEEN 3758096384 AND 4026531839, false)
             OR (NOT is4 AND is6 AND starts_with(lower(ip), 'ff')) AS is_multicast,
             CASE WHEN is4 THEN 4 WHEN is6 THEN 6 ELSE 0 END AS version FROM nums""",
    ),
)
def ip_domain_enrichment(spark, sf_dir):
    ip = F.col("ip")
    return ips(spark, sf_dir).select(
        "event_id",
        "ip",
        net.is_multicast_ip(ip).alias("is_multicast"),
        F.coalesce(net.ip_version(ip), F.lit(0)).alias("version"),
    )


@query(
    "domain_enrichment",
    "WITH a AS (SELECT 1)" + PHISHY_SQL + """ SELECT page_id, domain, lower(string_split(domain, '.')[-1]) AS tld,
        len(string_split(domain, '.')) - 2 AS subdomain_levels,
        lower(string_split(domain, '.')[-1]) IN ('tk', 'ml', 'ga', 'cf') AS suspicious_tld,
        len(string_split(domain, '.')) - 2 > 3 AS excessive_subdomains,
        array_to_string(list_slice(string_split(lower(domain), '.'), -2, -1), '.') AS registered FROM phishy""",
)
def domain_enrichment(spark, sf_dir):
    d = F.col("domain")
    return phishy(spark, sf_dir).select(
        "page_id",
        "domain",
        net.tld(d).alias("tld"),
        net.subdomain_levels(d).alias("subdomain_levels"),
        net.has_suspicious_tld(d).alias("suspicious_tld"),
        net.has_excessive_subdomains(d).alias("excessive_subdomains"),
        net.registered_domain(d).alias("registered"),
    )


HASHES_SQL = """, hashes AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text)
    WHEN 3 THEN '$2b$12$' || md5(text) WHEN 4 THEN '$6$' || md5(text) WHEN 5 THEN left(sha256(text), 56)
    ELSE left(text, 12) END AS h FROM documents)"""


def hashes(spark, sf_dir):
    slot = F.col("doc_id") % 7
    body = F.col("text")
    return adapt.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(slot == 0, F.md5(body))
        .when(slot == 1, F.sha1(body))
        .when(slot == 2, F.sha2(body, 256))
        .when(slot == 3, F.concat(F.lit("$2b$12$"), F.md5(body)))
        .when(slot == 4, F.concat(F.lit("$6$"), F.md5(body)))
        .when(slot == 5, F.left(F.sha2(body, 256), F.lit(56)))
        .otherwise(F.left(body, F.lit(12)))
        .alias("h"),
    )


@query(
    "hash_type",
    "WITH a AS (SELECT 1)" + HASHES_SQL + " SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(lower(trim(h)), '^(0x)?[a-f0-9]{{{n}}}$') THEN '{t}'" for n, t in text.HASH_LENGTHS.items())
    + " ".join(f" WHEN starts_with(lower(trim(h)), '{p}') THEN '{t}'" for p, t in text.HASH_PREFIXES.items())
    + " ELSE 'none' END AS kind, ("
    + " OR ".join(f"regexp_matches(h, {s.text(p)})" for p in text.PASSWORD_HASH_SHAPES)
    + ") AS password_hash FROM hashes",
)
def hash_type(spark, sf_dir):
    h = F.col("h")
    return hashes(spark, sf_dir).select(
        "doc_id",
        F.coalesce(text.hash_type(h), F.lit("none")).alias("kind"),
        text.looks_like_password_hash(h).alias("password_hash"),
    )


@query(
    "transforms",
    s.with_ctes(
        "messages",
        """SELECT entry_id, upper(source) AS up, lower(source) AS low, md5(message) AS m5, sha256(message) AS s256,
        base64(encode(source)) AS b64, reverse(message) AS rev, CAST(length(message) AS VARCHAR) AS len FROM messages""",
    ),
)
def transforms(spark, sf_dir):
    m, src = F.col("message"), F.col("source")
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        text.transform(src, "upper").alias("up"),
        text.transform(src, "lower").alias("low"),
        text.transform(m, "md5").alias("m5"),
        text.transform(m, "sha256").alias("s256"),
        text.transform(src, "base64").alias("b64"),
        text.transform(m, "reverse").alias("rev"),
        text.transform(m, "length").alias("len"),
    )


@query(
    "masking",
    s.with_ctes(
        "messages",
        """SELECT entry_id, CASE WHEN length(message) > 8 THEN left(message, 4) || repeat('*', length(message) - 8)
             || right(message, 4) ELSE repeat('*', length(message)) END AS secret,
        CASE WHEN length("user") > 4 THEN left("user", 2) || repeat('*', length("user") - 4) || right("user", 2)
             ELSE repeat('*', length("user")) END AS value_mask,
        left("user", 1) || repeat('*', length("user") - 2) || right("user", 1) || '@example.org' AS mail_mask
        FROM messages""",
    ),
)
def masking(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        text.mask_secret(F.col("message")).alias("secret"),
        text.mask_value(F.col("user")).alias("value_mask"),
        text.mask_username(F.concat("user", F.lit("@example.org"))).alias("mail_mask"),
    )


@query(
    "tcp_flags",
    """WITH f AS (SELECT event_id, CAST(user_id * 7 + event_id AS BIGINT) % 256 AS flags FROM events)
    SELECT event_id, flags, concat_ws(',', """
    + ", ".join(f"CASE WHEN flags & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(net.TCP_FLAGS))
    + """) AS names, flags = 0 OR (flags & 41) = 41 OR (flags & 3) = 3 AS suspicious,
    concat_ws(',', CASE WHEN flags & 2 <> 0 AND flags & 16 = 0 THEN 'syn_packet' END, CASE WHEN flags = 0 THEN 'null_scan' END,
      CASE WHEN (flags & 41) = 41 THEN 'xmas_scan' END, CASE WHEN (flags & 3) = 3 THEN 'syn_fin' END) AS tags FROM f""",
)
def tcp_flags(spark, sf_dir):
    flags = ((F.col("user_id") * 7 + F.col("event_id")) % 256).alias("flags")
    f = F.col("flags")
    return (
        adapt.table(spark, sf_dir, "events")
        .select("event_id", flags)
        .select(
            "event_id",
            "flags",
            joined(net.tcp_flag_names(f)).alias("names"),
            net.has_suspicious_flags(f).alias("suspicious"),
            joined(net.tcp_flag_tags(f)).alias("tags"),
        )
    )


@query(
    "time_buckets",
    """SELECT event_id, epoch_us(time_bucket(INTERVAL '5 minutes', ts)) // 1000000 AS five_minutes,
    epoch_us(date_trunc('hour', ts)) // 1000000 AS hour_start, epoch_us(date_trunc('day', ts)) // 1000000 AS day_start,
    epoch_us(CAST(date_trunc('week', ts) AS TIMESTAMP)) // 1000000 AS week_start,
    strftime(last_day(ts), '%Y-%m-%d') AS month_end FROM events""",
)
def time_buckets(spark, sf_dir):
    ts = F.col("ts")
    return (
        adapt.table(spark, sf_dir, "events")
        .withColumn("ts", ts.cast("timestamp"))
        .select(
            "event_id",
            F.unix_seconds(clock.time_bucket(ts, 300)).alias("five_minutes"),
            F.unix_seconds(F.date_trunc("hour", ts)).alias("hour_start"),
            F.unix_seconds(F.date_trunc("day", ts)).alias("day_start"),
            F.unix_seconds(F.date_trunc("week", ts)).alias("week_start"),
            F.date_format(F.last_day(ts), "yyyy-MM-dd").alias("month_end"),
        )
    )


@query(
    "bucket_spine",
    """WITH b AS (SELECT user_id, time_bucket(INTERVAL '1 day', min(ts)) AS lo, time_bucket(INTERVAL '1 day', max(ts)) AS hi
        FROM events GROUP BY 1)
    SELECT user_id, epoch_us(unnest(generate_series(lo, hi, INTERVAL '1 day'))) // 1000000 AS bucket_s FROM b""",
)
def bucket_spine(spark, sf_dir):
    bounds = adapt.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return clock.bucket_spine(bounds, "lo", "hi", 86400).select("user_id", F.unix_seconds("bucket").alias("bucket_s"))


@query(
    "business_hours",
    """SELECT event_id, isodow(ts) <= 5 AND hour(ts) >= 9 AND hour(ts) < 17 AS business,
    strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') <= '05:00' AS night FROM events""",
)
def business_hours(spark, sf_dir):
    return adapt.table(spark, sf_dir, "events").select(
        "event_id",
        clock.is_business_hours(F.col("ts")).alias("business"),
        clock.between_times(F.col("ts").cast("timestamp"), "22:00", "05:00").alias("night"),
    )


@query(
    "durations",
    """WITH d AS (SELECT event_id, (event_id * 7919) % 400000 AS secs FROM events),
    t AS (SELECT event_id, secs, trim(concat_ws(' ', CASE WHEN secs // 86400 > 0 THEN (secs // 86400) || 'd' END,
        CASE WHEN secs % 86400 // 3600 > 0 THEN (secs % 86400 // 3600) || 'h' END,
        CASE WHEN secs % 3600 // 60 > 0 THEN (secs % 3600 // 60) || 'm' END,
        CASE WHEN secs % 60 > 0 THEN (secs % 60) || 's' END)) AS txt FROM d)
    SELECT event_id, CASE WHEN txt = '' THEN '0s' ELSE txt END AS duration_text, secs AS parsed FROM t""",
)
def durations(spark, sf_dir):
    secs = (F.col("event_id") * 7919) % 400000
    return (
        adapt.table(spark, sf_dir, "events")
        .select("event_id", clock.format_duration(secs).alias("duration_text"))
        .withColumn("parsed", clock.parse_duration(F.col("duration_text")))
    )


AS_OF = "2024-01-20 12:00:00"


@query(
    "relative_time_tests",
    f"""WITH e AS (SELECT event_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6 AS age FROM events)
    SELECT event_id, age <= 7200 AS within_2h, age > 864000 AS older_10d, age <= 86400 AS recent FROM e""",
)
def relative_time_tests(spark, sf_dir):
    ts, as_of = F.col("ts"), F.lit(AS_OF).cast("timestamp")
    return adapt.table(spark, sf_dir, "events").select(
        "event_id",
        clock.within_last(ts, 7200, as_of).alias("within_2h"),
        clock.older_than(ts, 864000, as_of).alias("older_10d"),
        clock.is_recent(ts, as_of).alias("recent"),
    )


OBFUSCATED_SQL = """, o AS (SELECT entry_id, CASE k % 6 WHEN 0 THEN base64(encode(message)) WHEN 1 THEN hex(encode(message))
    WHEN 2 THEN '%41%42%43 ' || k WHEN 3 THEN 'eval (atob(x)) ' || k WHEN 4 THEN '\\u0041\\u0042' || k ELSE message END AS t
    FROM messages)"""


@query(
    "obfuscation_flags",
    s.with_ctes(
        "messages",
        OBFUSCATED_SQL.replace("\\\\", "\\") + r""" SELECT entry_id, concat_ws(',',
        CASE WHEN regexp_matches(t, '^[A-Za-z0-9+/]{20,}={0,2}$') THEN 'base64' END,
        CASE WHEN regexp_matches(t, '^[0-9a-fA-F\s]{20,}$') THEN 'hex_encoding' END,
        CASE WHEN length(t) - length(replace(t, '%', '')) > length(t) * 0.1 THEN 'url_encoding' END,
        CASE WHEN regexp_matches(t, '\\u[0-9a-fA-F]{4}') THEN 'unicode_escape' END,
        CASE WHEN length(t) - length(replace(t, '\', '')) > length(t) * 0.1 THEN 'excessive_escaping' END, """
        + ", ".join(f"CASE WHEN regexp_matches(t, {s.text(p)}) THEN {s.text(n)} END" for n, p in text.OBFUSCATION_CALLS.items())
        + ") AS flags FROM o",
    ),
)
def obfuscation_flags(spark, sf_dir):
    k, m = F.col("k"), F.col("message")
    ks = k.cast("string")
    shown = (
        F.when(k % 6 == 0, text.transform(m, "base64"))
        .when(k % 6 == 1, F.hex(m))
        .when(k % 6 == 2, F.concat(F.lit("%41%42%43 "), ks))
        .when(k % 6 == 3, F.concat(F.lit("eval (atob(x)) "), ks))
        .when(k % 6 == 4, F.concat(F.lit("\\u0041\\u0042"), ks))
        .otherwise(m)
    )
    return adapt.messages(spark, sf_dir).select("entry_id", joined(text.obfuscation_flags(shown)).alias("flags"))


@query(
    "clean_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'),
    '[\t\n\f\r \x0B]+', ' ', 'g'))) AS cleaned FROM documents""",
)
def clean_text(spark, sf_dir):
    return adapt.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


def words_in(column, ws):
    return s.has_any(f"lower({column})", ws)


PREDICATE_SQL = f"""
    SELECT entry_id, contains(lower(message), 'login') AS login,
      contains(lower(message), 'login') AND contains(lower(message), 'fail') AS failed,
      contains(lower(message), 'login') AND contains(lower(message), 'success') AND NOT contains(lower(message), 'fail') AS succeeded,
      contains(lower(message), 'access') AS accessed,
      {words_in('message', predicates.SENSITIVE_WORDS)} AS sensitive,
      {words_in('message', predicates.CONFIG_WORDS)} AS config,
      k * 2000000 > 100000000 AS large, contains(lower(message), 'service') AND event_type IN ('create', 'modify', 'delete', 'change')
        AS service, k > 70 AND contains(lower(message), 'login') AS unusual, contains(lower(message), 'registry') AS registry
    FROM messages"""


@query("event_predicates", s.with_ctes("messages", PREDICATE_SQL))
def event_predicates(spark, sf_dir):
    df = adapt.messages(spark, sf_dir).select(
        "entry_id",
        "message",
        F.col("message").alias("target"),
        F.col("message").alias("file"),
        F.col("event_type").alias("action"),
        F.col("k").alias("risk_score"),
        (F.col("k") * 2_000_000).alias("bytes"),
    )
    e = predicates.EventFields(df)
    return df.select(
        "entry_id",
        e.is_login().alias("login"),
        e.is_failed_login().alias("failed"),
        e.is_successful_login().alias("succeeded"),
        e.is_access().alias("accessed"),
        e.is_suspicious_access().alias("sensitive"),
        e.is_config_change().alias("config"),
        e.is_large_transfer().alias("large"),
        e.is_service_modification().alias("service"),
        e.is_unusual_login().alias("unusual"),
        e.is_registry_change().alias("registry"),
    )


@query(
    "event_ids",
    s.with_ctes(
        "log_events",
        """SELECT event_id, md5(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || event_type || '|' || source || '|') AS id
        FROM log_events""",
    ),
)
def event_ids(spark, sf_dir):
    return adapt.log_events(spark, sf_dir).select(
        "event_id", predicates.event_id(F.col("ts"), F.col("event_type"), F.col("source"), F.lit(None)).alias("id")
    )


@query(
    "event_descriptions",
    s.with_ctes(
        "log_events",
        """SELECT event_id, CASE k % 3 WHEN 0 THEN 'Login by ' || "user" || ' from ' || source
          WHEN 1 THEN 'Network connection from ' || source || ' to unknown' ELSE event_type || ' ' || action || ' from ' || source
          END AS described FROM log_events""",
    ),
)
def event_descriptions(spark, sf_dir):
    k = F.col("k")
    df = adapt.log_events(spark, sf_dir).withColumn(
        "event_type", F.when(k % 3 == 0, "login").when(k % 3 == 1, "network").otherwise(F.col("event_type"))
    )
    return df.select("event_id", predicates.describe_event(predicates.EventFields(df)).alias("described"))


URLS_SQL = """, u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, '/', '/') WHEN 1 THEN
      regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || ':8080/shell.php?a=1' WHEN 2 THEN
      regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || ':443/x/upload.php' ELSE url END AS url FROM pages)"""


def made_urls(spark, sf_dir):
    root = F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0)
    slot = F.col("page_id") % 5
    return adapt.urls(spark, sf_dir).select(
        "page_id",
        F.when(slot == 1, F.concat(root, F.lit(":8080/shell.php?a=1")))
        .when(slot == 2, F.concat(root, F.lit(":443/x/upload.php")))
        .otherwise(F.col("url"))
        .alias("url"),
    )


URL_PARTS_SQL = r"""lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host,
    coalesce(try_cast(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?[^/:?#]+:(\d{1,5})', 1) AS INTEGER), 0) AS port,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path"""


@query(
    "url_parts",
    "WITH a AS (SELECT 1)" + URLS_SQL + f", p AS (SELECT page_id, {URL_PARTS_SQL} FROM u)"
    + f""" SELECT page_id, host, port, path, port IN {net.C2_PORTS} AS c2_port,
        {s.has_any('lower(path)', net.WEBSHELL_PATHS)} AS webshell FROM p""",
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return made_urls(spark, sf_dir).select(
        "page_id",
        net.url_host(u).alias("host"),
        F.coalesce(net.url_port(u), F.lit(0)).alias("port"),
        net.url_path(u).alias("path"),
        net.has_c2_port(u).alias("c2_port"),
        net.has_webshell_path(u).alias("webshell"),
    )


@query(
    "email_parts",
    """WITH m AS (SELECT page_id, 'Ops Team ' || page_id || ' <Ops' || page_id || '@' ||
        regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || '>' AS a, 'x@example.com' AS b FROM pages)
    SELECT page_id, lower(regexp_extract(a, '<([^>]+)>', 1)) AS address, trim(regexp_extract(a, '^([^<]+)<', 1)) AS display,
      split_part(lower(regexp_extract(a, '<([^>]+)>', 1)), '@', 2) AS domain,
      split_part(lower(regexp_extract(a, '<([^>]+)>', 1)), '@', 2) = 'example.com'
        OR ends_with(split_part(lower(regexp_extract(a, '<([^>]+)>', 1)), '@', 2), '.example.com') AS same_domain FROM m""",
)
def email_parts(spark, sf_dir):
    raw = F.concat(
        F.lit("Ops Team "), F.col("page_id").cast("string"), F.lit(" <Ops"), F.col("page_id").cast("string"), F.lit("@"),
        net.url_host(F.col("url")), F.lit(">"),
    )
    address = net.email_address(F.col("a"))
    return (
        adapt.urls(spark, sf_dir)
        .select("page_id", raw.alias("a"))
        .select(
            "page_id",
            address.alias("address"),
            net.email_display_name(F.col("a")).alias("display"),
            net.email_domain(address).alias("domain"),
            net.same_domain(address, F.lit("x@example.com")).alias("same_domain"),
        )
    )


@query(
    "homograph_test",
    f"""WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'paypal' || page_id || '.com' WHEN 1 THEN 'gоogle.com'
        ELSE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) END AS domain FROM pages)
    SELECT page_id, (regexp_matches(domain, '[а-яА-Я]') AND regexp_matches(domain, '[a-zA-Z]'))
       OR ({s.has_any('domain', text.HOMOGRAPH_BRANDS)} AND {s.has_any('domain', text.HOMOGRAPH_CHARS)}) AS homograph FROM d""",
)
def homograph_test(spark, sf_dir):
    slot = F.col("page_id") % 3
    domain = (
        F.when(slot == 0, F.concat(F.lit("paypal"), F.col("page_id").cast("string"), F.lit(".com")))
        .when(slot == 1, "gоogle.com")
        .otherwise(net.url_host(F.col("url")))
    )
    return adapt.urls(spark, sf_dir).select("page_id", text.is_homograph(domain).alias("homograph"))


def _ends_with_any(column, endings):
    return "(" + " OR ".join(f"ends_with({column}, {s.text(e)})" for e in endings) + ")"


@query(
    "suspicious_host_tests",
    s.with_ctes(
        "messages",
        f""", h AS (SELECT entry_id, message, CASE k % 4 WHEN 0 THEN 'C:\\Users\\Public\\a' || k || '.exe' WHEN 1 THEN 'C:\\x.dll'
              WHEN 2 THEN 'C:\\Windows\\Temp\\hook.dll' ELSE message END AS p,
              CASE k % 3 WHEN 0 THEN 'lsass.exe' WHEN 1 THEN 'csrss.exe' ELSE 'my app' END AS proc, k FROM messages)
        SELECT entry_id, {' OR '.join(f"regexp_matches(lower(message), {s.text(p)})" for p in host.COMMAND_LINE_PATTERNS)} AS command,
          {s.has_any('lower(p)', host.TEMP_PATHS)} AND {_ends_with_any('lower(p)', host.EXECUTABLE_ENDINGS)} AS path,
          {s.has_any('lower(p)', host.DLL_NAMES)} OR {s.has_any('lower(p)', host.DLL_PATHS)} AS dll,
          (proc = 'csrss.exe' AND k <> 4) OR proc = 'lsass.exe' OR contains(proc, ' ') AS process,
          {s.has_any('message', host.REGISTRY_PARTS)} AS registry FROM h""".replace("\\\\", "\\"),
    ),
)
def suspicious_host_tests(spark, sf_dir):
    k, m = F.col("k"), F.col("message")
    p = (
        F.when(k % 4 == 0, F.concat(F.lit("C:\\Users\\Public\\a"), k.cast("string"), F.lit(".exe")))
        .when(k % 4 == 1, "C:\\x.dll")
        .when(k % 4 == 2, "C:\\Windows\\Temp\\hook.dll")
        .otherwise(m)
    )
    proc = F.when(k % 3 == 0, "lsass.exe").when(k % 3 == 1, "csrss.exe").otherwise("my app")
    return adapt.messages(spark, sf_dir).select(
        "entry_id",
        host.is_suspicious_command_line(m).alias("command"),
        host.is_suspicious_path(p).alias("path"),
        host.is_suspicious_dll(p).alias("dll"),
        host.is_suspicious_process(proc, k).alias("process"),
        host.is_suspicious_registry_key(m).alias("registry"),
    )


@query(
    "timestamp_formats",
    """SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS seconds FROM events""",
)
def timestamp_formats(spark, sf_dir):
    """Events written in seven notations and read back."""
    ts = F.col("ts").cast("timestamp")
    slot = F.col("event_id") % 7
    shown = (
        F.when(slot == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(slot == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(slot == 2, F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss Z"))
        .when(slot == 3, F.unix_seconds(ts).cast("string"))
        .when(slot == 4, F.unix_millis(F.date_trunc("second", ts)).cast("string"))
        .when(slot == 5, F.date_format(ts, "MMM d HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return adapt.table(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds(clock.normalize_timestamp(shown, year=2024)).alias("seconds")
    )


@query(
    "time_zone_conversion",
    """WITH e AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'US/Eastern' WHEN 1 THEN 'UTC' ELSE 'Europe/London' END AS z
        FROM events)
    SELECT event_id, epoch_us(ts) // 1000000 + CASE WHEN z = 'US/Eastern' THEN 18000 ELSE 0 END AS utc_seconds FROM e""",
)
def time_zone_conversion(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 0, "EST").when(F.col("event_id") % 3 == 1, "GMT").otherwise("Europe/London")
    return adapt.table(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds(clock.to_utc(F.col("ts").cast("timestamp"), zone)).alias("utc_seconds")
    )


@query(
    "norm_severity",
    s.with_ctes("messages", """SELECT entry_id, CASE level WHEN 'error' THEN 'high' ELSE level END AS severity FROM messages"""),
)
def norm_severity(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select("entry_id", text.norm_severity(F.col("level")).alias("severity"))

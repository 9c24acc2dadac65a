"""Indicators of compromise out of text, as a long table (entry, type, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import net
from logsieve.functions.rows import bind, explode_computed
from logsieve.functions.text import contains_any, is_dga_by_entropy, is_phishing_context, matched_names

# fixed values: patterns of the basic pass
BASIC_PATTERNS = {
    "ips": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "domains": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "urls": r'https?://[^\s<>"{}|\\^`\[\]]+',
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "hashes": r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b",
    "files": r'(?:[A-Za-z]:\\|/)(?:[^\\/:*?"<>|\r\n]+[\\/])*[^\\/:*?"<>|\r\n]+',
}
BASIC_DOMAIN_ENDINGS = (".log", ".txt", ".json", ".xml")

# fixed values: patterns of the advanced pass
IPV6_PATTERN = (
    r"(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}|:(?:(?::[0-9a-fA-F]{1,4}){1,7}|:))"
)
URL_PATTERN = (
    r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)"
)
ADVANCED_PATTERNS = {
    "ipv4": BASIC_PATTERNS["ips"],
    "ipv6": IPV6_PATTERN,
    "domain": BASIC_PATTERNS["domains"],
    "url": URL_PATTERN,
    "suspicious_url": r"https?://[^\s]+(?:\.php\?|\.exe|\.zip|\.rar|\.7z|\.bat|\.cmd|\.ps1|\.vbs)",
    "email": BASIC_PATTERNS["emails"],
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "sha512": r"\b[a-fA-F0-9]{128}\b",
    "windows_path": r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]+',
    "unix_path": r"(?:/[^/\x00]+)+/?",
    "registry_key": (
        r"(?:HKEY_LOCAL_MACHINE|HKLM|HKEY_CURRENT_USER|HKCU|HKEY_CLASSES_ROOT|HKCR|HKEY_USERS|HKU)\\[\\A-Za-z0-9_\-\.]+"
    ),
    "bitcoin": r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b|bc1[a-z0-9]{39,59}",
    "cve": r"CVE-\d{4}-\d{4,7}",
    "base64": r"(?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
    "powershell_encoded": r"-[Ee]nc(?:odedCommand)?\s+[A-Za-z0-9+/=]+",
    "suspicious_command": r"""(?:cmd|powershell|bash|sh).*(?:/c|/k|-Command|-c)\s+["']?.*["']?""",
}
# fixed values: kinds to ask for beside them
MORE_PATTERNS = {
    "subdomain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.){2,}[a-zA-Z]{2,}\b",
    "ethereum": r"\b0x[a-fA-F0-9]{40}\b",
    "monero": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b",
}
MAPPED_KINDS = ("ips", "domains", "urls", "hashes")  # of the basic pass, those that point to techniques
# what every match holds, literally or as a shorter expression: texts without it skip the pattern
NEEDED = {
    "domains": (".",), "urls": ("://",), "emails": ("@",), "domain": (".",), "subdomain": (".",), "url": ("://",), "suspicious_url": ("://",), "email": ("@",),
    "windows_path": (":\\",), "unix_path": ("/",), "registry_key": ("HK",), "cve": ("CVE-",), "powershell_encoded": ("-enc", "-Enc"), "ethereum": ("0x",),
}
NEEDED_RUN = {
    "ips": r"\d\.\d", "ipv4": r"\d\.\d", "ipv6": r"::|(?::[0-9a-fA-F]{1,4}){7}", "suspicious_command": r"(?:/c|/k|-Command|-c)\s", "monero": r"4[0-9AB]",
    "bitcoin": r"[13][a-km-zA-HJ-NP-Z1-9]{25}|bc1",
}
# the same languages written without backtracking into a repeated group
POSSESSIVE = {
    "unix_path": r"(?:/[^/\x00]++)++/?+",
    "base64": r"(?:[A-Za-z0-9+/]{4}){10,}+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
}
ADVANCED_TYPES = {
    "ipv4": "ips", "ipv6": "ips", "domain": "domains", "url": "urls", "suspicious_url": "urls", "email": "emails",
    "md5": "hashes", "sha1": "hashes", "sha256": "hashes", "sha512": "hashes", "windows_path": "file_paths",
    "unix_path": "file_paths", "registry_key": "registry_keys", "bitcoin": "bitcoin_addresses", "cve": "cves",
    "base64": "base64_strings", "powershell_encoded": "commands", "suspicious_command": "commands",
    "subdomain": "domains", "ethereum": "ethereum_addresses", "monero": "monero_addresses",
}
LOWERED = ("domain", "subdomain", "email", "md5", "sha1", "sha256", "sha512")

# fixed values: well-known values that are no indicators
WHITELIST_DOMAINS = (
    "google.com", "googleapis.com", "microsoft.com", "windows.com", "apple.com", "amazon.com", "cloudflare.com",
    "akamai.com", "github.com", "stackoverflow.com", "wikipedia.org",
)
WHITELIST_IPS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "208.67.222.222", "208.67.220.220", "127.0.0.1", "::1", "0.0.0.0",
)
WHITELIST_ENDINGS = (".txt", ".log", ".conf", ".ini", ".cfg", ".jpg", ".png", ".gif", ".pdf", ".doc")
EMPTY_FILE_HASHES = (
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
# fixed values: wording around indicators
CONTEXT_PATTERNS = {
    "c2_beacon": r"(?i)(?:beacon|heartbeat|check-?in|callback|poll).*(?:interval|frequency|period)",
    "c2_commands": r"(?i)(?:exec|execute|run|download|upload|shell|cmd).*(?:command|payload|task)",
    "exfil_keywords": r"(?i)(?:exfil|steal|harvest|collect|gather|extract).*(?:data|file|document|credential)",
    "large_transfer": r"(?i)(?:transfer|upload|send).*(?:\d+\s*[MG]B|\d{7,}\s*bytes)",
    "malware_family": r"(?i)(?:emotet|trickbot|ryuk|conti|lockbit|revil|darkside|maze|netwalker|sodinokibi)",
    "malware_behavior": r"(?i)(?:inject|hook|persistence|elevation|bypass|disable.*(?:defender|antivirus))",
    "exploit_attempt": r"(?i)(?:exploit|overflow|injection|traversal|inclusion|deserializ)",
    "cve_exploit": r"(?i)(?:exploit.*CVE|CVE.*exploit|vulnerability.*exploit)",
    "phishing_keywords": (
        r"(?i)(?:verify.*account|suspended.*account|click.*here|urgent.*action|confirm.*identity)"
    ),
    "phishing_domains": (
        r"(?i)(?:secure|account|verify|update|confirm|banking|paypal|amazon|microsoft|google|apple)"
        r".*(?:\.tk|\.ml|\.ga|\.cf)"
    ),
}
SUSPICIOUS_AGENTS = (
    "Mozilla/4.0 (compatible; MSIE 6.0; Windows NT 5.1; SV1)", "Python-urllib", "curl", "Wget",
)
ATTACHMENT_PATTERN = r"""(?i)filename["']?[:=]\s*["']?([^"';\s]+)["']?"""
ATTACHMENT_ENDINGS = (".exe", ".scr", ".vbs", ".js", ".zip", ".rar")


def find_all(text: Column, patterns: Mapping[str, str]) -> Column:
    """Array of (kind, value) of every match of every pattern, without repeats inside the text."""
    return F.concat(*[_matches(text, name, pattern, name in LOWERED) for name, pattern in patterns.items()])


def _matches(text: Column, name: str, pattern: str, lowered: bool) -> Column:
    values = F.array_distinct(F.regexp_extract_all(text, F.lit(POSSESSIVE.get(name, pattern)), F.lit(0)))
    if name in NEEDED:
        values = F.when(reduce(or_, [F.contains(text, F.lit(word)) for word in NEEDED[name]]), values).otherwise(F.array().cast("array<string>"))
    elif name in NEEDED_RUN:
        values = F.when(text.rlike(NEEDED_RUN[name]), values).otherwise(F.array().cast("array<string>"))
    return F.transform(
        values, lambda v: F.struct(F.lit(name).alias("kind"), (F.lower(v) if lowered else v).alias("value"))
    )


def extract(df: DataFrame, text: Column, patterns: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (row of df, kind, value) found; the text itself is not carried along."""
    found = explode_computed(df, keep, find_all(F.coalesce(text, F.lit("")), patterns), "_m")
    return found.select(*keep, F.col("_m.kind").alias("kind"), F.col("_m.value").alias("ioc_value"))


def extract_iocs(
    df: DataFrame, columns: Sequence[str] = ("message",), keep: Sequence[str] = ("entry_id", "file_id"), kinds: Sequence[str] = tuple(BASIC_PATTERNS)
):
    """Basic pass: addresses, domains, URLs, mail addresses, hashes and paths, once per entry; only `kinds` are looked for."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    found = extract(df, text, {k: BASIC_PATTERNS[k] for k in kinds}, keep).withColumnRenamed("kind", "ioc_type")
    is_file_name = F.lit(False)
    for ending in BASIC_DOMAIN_ENDINGS:
        is_file_name = is_file_name | F.col("ioc_value").endswith(ending)
    return found.where(~((F.col("ioc_type") == "domains") & is_file_name))


def distinct_iocs(iocs: DataFrame, per: Sequence[str] = ("file_id",)) -> DataFrame:
    return iocs.groupBy(*per, "ioc_type", "ioc_value").agg(F.count(F.lit(1)).alias("mentions"))


def is_valid_domain(domain: Column) -> Column:
    file_like = F.lit(False)
    for ending in WHITELIST_ENDINGS:
        file_like = file_like | domain.endswith(ending)
    return (
        (F.length(domain) >= 4)
        & domain.contains(".")
        & ~file_like
        & ~net.registered_domain(domain).isin(*WHITELIST_DOMAINS)
    )


def is_valid_ioc(kind: Column, value: Column) -> Column:
    """The check that belongs to the kind of indicator."""
    host = F.regexp_replace(net.url_host(value), r"^www\.", "")
    mail_domain = net.email_domain(value)
    return (
        F.when(kind.isin("ipv4", "ipv6"), net.is_public_ip(value) & ~value.isin(*WHITELIST_IPS))
        .when(kind.isin("domain", "subdomain"), is_valid_domain(value))
        .when(kind == "url", is_valid_domain(host))
        .when(kind == "email", is_valid_domain(mail_domain) & (F.length(F.regexp_replace(value, "[^@]", "")) == 1))
        .when(kind.isin("md5", "sha1", "sha256", "sha512"), ~value.isin(*EMPTY_FILE_HASHES))
        .when(kind == "windows_path", F.length(value) > 3)
        .when(kind == "unix_path", (F.length(value) > 1) & ~value.rlike("^/+$"))
        .when(kind == "bitcoin", F.length(value).between(26, 35))
        .when(kind == "base64", F.length(value) >= 40)
        .otherwise(F.lit(True))
    )


def ioc_group(kind: Column) -> Column:
    return net.lookup(kind, ADVANCED_TYPES)


def extract_advanced(
    df: DataFrame,
    columns: Sequence[str] = ("message",),
    keep: Sequence[str] = ("entry_id", "file_id"),
    whitelist: DataFrame | None = None,
    patterns: Mapping[str, str] = ADVANCED_PATTERNS,
) -> DataFrame:
    """Advanced pass: more kinds, each validated; `whitelist(ioc_value)` drops further values.

    `{**ADVANCED_PATTERNS, **MORE_PATTERNS}` adds sub-domains and two more currencies.
    """
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    found = extract(df, text, patterns, keep).where(is_valid_ioc(F.col("kind"), F.col("ioc_value")))
    if whitelist is not None:
        found = found.join(whitelist.select("ioc_value"), "ioc_value", "left_anti")
    return found.withColumn("ioc_type", ioc_group(F.col("kind")))


def hash_contexts(df: DataFrame, text: str = "message", keep: Sequence[str] = ("entry_id",), around: int = 50):
    """Each hash with the characters around its first place in the text."""
    hits = [_matches(F.col(text), n, ADVANCED_PATTERNS[n], False) for n in ("md5", "sha1", "sha256", "sha512")]
    rows = explode_computed(df, [*keep, F.col(text).alias("_t")], F.concat(*hits), "_m")
    at = F.position(F.col("_m.value"), F.col("_t"))
    start = F.greatest(at - around, F.lit(1))
    size = at + F.length("_m.value") + around - start
    return rows.select(
        *keep,
        F.col("_m.kind").alias("kind"),
        F.lower("_m.value").alias("ioc_value"),
        F.substring(F.col("_t"), start, size).alias("context"),
    ).where(~F.col("ioc_value").isin(*EMPTY_FILE_HASHES))


def context_flags(df: DataFrame, text: str = "message", keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    """One row per wording pattern found in a text."""
    return explode_computed(df, keep, matched_names(F.col(text), CONTEXT_PATTERNS), "flag")


def base64_previews(iocs: DataFrame, value: str = "ioc_value") -> DataFrame:
    """First 100 encoded and first 50 decoded characters of base64 strings."""
    raw = F.try_to_binary(F.col(value), F.lit("base64"))
    decoded = F.try_validate_utf8(raw.cast("string"))
    return iocs.where(F.length(value) >= 40).select(
        "*",
        F.when(F.length(value) > 100, F.concat(F.substring(value, 1, 100), F.lit("..."))).otherwise(F.col(value)).alias("encoded"),
        F.when(F.length(decoded) > 50, F.concat(F.substring(decoded, 1, 50), F.lit("..."))).otherwise(decoded).alias("decoded_preview"),
    )


def ioc_summary(iocs: DataFrame) -> DataFrame:
    return iocs.groupBy("ioc_type").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_distinct("ioc_value").alias("distinct_values"),
        F.count_distinct("file_id").alias("files"),
    )


def url_intel(urls: DataFrame, url: str = "url") -> DataFrame:
    """URLs on known command ports or with a web-shell path."""
    u = F.col(url)
    flags = F.array_compact(
        F.array(
            F.when(net.has_c2_port(u), F.struct(F.lit("suspicious_port").alias("finding"), F.lit(0.8).alias("confidence"))),
            F.when(net.has_webshell_path(u), F.struct(F.lit("webshell_path").alias("finding"), F.lit(0.9).alias("confidence"))),
        )
    )
    return explode_computed(urls, urls.columns, flags, "_f").select(*urls.columns, "_f.finding", "_f.confidence")


def domain_verdicts(domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Generated-looking and phishing-looking domains."""
    d = F.col(domain)
    flags = F.array_compact(
        F.array(
            F.when(is_dga_by_entropy(d), F.struct(F.lit("potential_dga").alias("threat_type"), F.lit(0.7).alias("confidence"))),
            F.when(
                is_phishing_context(d),
                F.struct(F.lit("potential_phishing").alias("threat_type"), F.lit(0.8).alias("confidence")),
            ),
        )
    )
    found = explode_computed(domains, domains.columns, flags, "_f")
    return found.select(*domains.columns, "_f.threat_type", "_f.confidence")


def domain_ip_links(iocs: DataFrame, per: str = "file_id") -> DataFrame:
    """IP found inside a URL whose host is one of the domains of the same file.

    The addresses are taken out of the URL, so both sides meet on equality.
    """
    urls = iocs.where(F.col("ioc_type") == "urls").select(per, F.col("ioc_value").alias("url")).distinct()
    addresses = F.array_distinct(F.regexp_extract_all("url", F.lit(BASIC_PATTERNS["ips"]), F.lit(0)))
    inside = explode_computed(urls, [per, net.url_host(F.col("url")).alias("domain")], addresses, "ip")
    known_ips = iocs.where(F.col("ioc_type") == "ips").select(per, F.col("ioc_value").alias("ip")).distinct()
    known_domains = (
        iocs.where(F.col("ioc_type") == "domains").select(per, F.lower("ioc_value").alias("domain")).distinct()
    )
    return inside.join(known_ips, [per, "ip"], "left_semi").join(known_domains, [per, "domain"], "left_semi").distinct()


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    def cut(bound: Column) -> Column:
        last = F.greatest(F.length(bound) - size + 1, F.lit(1))
        return F.filter(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(bound, i, size)), lambda g: F.length(g) == size
        )

    return bind(text, cut)


def file_hash_links(contexts: DataFrame, paths: DataFrame, per: str = "file_id", path: str = "ioc_value") -> DataFrame:
    """File names that occur in the context of a hash of the same file.

    Both sides meet on the first characters of the name, then containment is checked, so
    a file with many hashes and paths is not paired up.
    """
    p = F.col(path)
    name = F.lower(F.element_at(F.when(p.contains("\\"), F.split(p, r"\\")).otherwise(F.split(p, "/")), -1))
    names = paths.select(per, name.alias("file_name")).where("file_name <> ''").distinct()
    names = names.withColumn("_gram", F.substring("file_name", 1, GRAM))
    around = F.lower("context")
    grams = explode_computed(
        contexts,
        [per, "kind", F.col("ioc_value").alias("hash"), around.alias("_context")],
        F.array_distinct(F.concat(*[_grams(around, n) for n in range(1, GRAM + 1)])),
        "_gram",
    )
    return (
        grams.join(names, [per, "_gram"])
        .where(F.contains("_context", F.col("file_name")))
        .select(per, "file_name", "hash", "kind")
        .distinct()
    )


def c2_infrastructure(bad_domains: DataFrame, indicators: DataFrame, per: str = "file_id", keep: int = 5) -> DataFrame:
    """Files with both bad domains and command-and-control wording: up to five domains and the number of indicators."""
    from logsieve.operators.fanout import first_values

    domains = first_values(bad_domains, [per], "domain", keep, "domains")
    counts = indicators.groupBy(per).agg(F.count(F.lit(1)).alias("indicators"))
    return domains.join(counts, per)


def entries_with_iocs(entries: DataFrame, iocs: DataFrame, entry: str = "entry_id") -> DataFrame:
    return entries.join(iocs.select(entry), entry, "left_semi")


def suspicious_agents(df: DataFrame, text: str = "message", keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    agent = F.trim(F.regexp_extract(text, r"User-Agent:([^\n]*)", 1))
    return df.select(*keep, agent.alias("user_agent")).where(F.col("user_agent").isin(*SUSPICIOUS_AGENTS))


def dga_dns_queries(df: DataFrame, text: str = "message", keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    is_dns = contains_any(F.col(text), ("DNS query", "DNS response"))
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(BASIC_PATTERNS["domains"]), F.lit(0)))
    found = explode_computed(df.where(is_dns), keep, named, "domain")
    return found.where(is_dga_by_entropy(F.lower("domain"))).withColumn("confidence", F.lit(0.8))


def suspicious_attachments(df: DataFrame, text: str = "message", keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    names = explode_computed(df, keep, F.regexp_extract_all(text, F.lit(ATTACHMENT_PATTERN), F.lit(1)), "attachment")
    bad = F.lit(False)
    for ending in ATTACHMENT_ENDINGS:
        bad = bad | F.lower("attachment").endswith(ending)
    return names.where(bad)


# fixed values: variants per kind of source
CLOUD_DOMAIN = r"(?:[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]\.)+[a-zA-Z]{2,}"
BUCKET = r"s3://([a-z0-9][a-z0-9\-\.]*[a-z0-9])"


def cloud_iocs(df: DataFrame, params: str, source_ip: str, key_id: str, keep: Sequence[str]) -> DataFrame:
    """Source address, addresses, domains and buckets of the request, and the masked key."""
    p = F.col(params)
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("ioc_value")))
    address = F.when(F.coalesce(F.col(source_ip), F.lit("")).isin("", "Unknown"), F.array().cast("array<string>")).otherwise(
        F.array(F.col(source_ip))
    )
    domains = F.filter(F.regexp_extract_all(p, F.lit(CLOUD_DOMAIN), F.lit(0)), lambda d: ~d.endswith(".amazonaws.com"))
    buckets = F.transform(
        F.regexp_extract_all(p, F.lit(BUCKET), F.lit(1)), lambda b: F.concat(b, F.lit(".s3.amazonaws.com"))
    )
    k = F.col(key_id)
    key = F.when(
        F.length(k) > 4, F.array(F.concat(F.lit("AWS_KEY_"), F.left(k, F.lit(4)), F.lit("..."), F.right(k, F.lit(4))))
    ).otherwise(F.array().cast("array<string>"))
    in_params = F.regexp_extract_all(p, F.lit(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), F.lit(0))
    found = F.concat(
        tagged("ips", F.array_union(address, in_params)), tagged("domains", F.array_union(domains, buckets)), tagged("keys", key)
    )
    return explode_computed(df, keep, F.array_distinct(found), "_i").select(*keep, "_i.ioc_type", "_i.ioc_value")


def flow_iocs(df: DataFrame, src: str, dst: str, port: str, keep: Sequence[str]) -> DataFrame:
    """Both addresses, and a mark for a backdoor port."""
    ioc = lambda kind, value: F.struct(F.lit(kind).alias("ioc_type"), value.alias("ioc_value"))
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col(src).cast("string"), F.lit("")) != "", ioc("ips", F.col(src).cast("string"))),
            F.when(F.coalesce(F.col(dst).cast("string"), F.lit("")) != "", ioc("ips", F.col(dst).cast("string"))),
            F.when(
                F.col(port).isin(*net.BACKDOOR_PORTS),
                ioc("domains", F.concat(F.lit("backdoor-port-"), F.col(port).cast("string"))),
            ),
        )
    )
    return explode_computed(df, keep, found, "_i").select(*keep, "_i.ioc_type", "_i.ioc_value")


LOOSE_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DIGESTS = r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"
QUOTED_URL = r"""https?://[^\s'"<>]+"""
LOCAL_PREFIXES = ("127.", "192.168.", "10.", "172.")
# fixed values: patterns per kind of source; `local_ips` keeps addresses of inner networks, `domains_of` names the
# kinds whose host or mail domain is an indicator too, `skip_endings` are domains that do not count
VARIANTS = {
    "device": {
        "patterns": {
            "ips": LOOSE_IP, "domains": r"(?:[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]\.)+[a-zA-Z]{2,}",
            "urls": BASIC_PATTERNS["urls"], "hashes": DIGESTS, "file_paths": r"(?:/data/|/system/|/sdcard/|/storage/)[^\s<>\"{}|\\^`\[\]]+",
        },
        "local_ips": False, "domains_of": (), "skip_endings": (".android.com", ".google.com", ".googleapis.com"),
    },
    "mail": {
        "patterns": {"emails": r"[\w.\-]+@[\w.\-]+", "urls": BASIC_PATTERNS["urls"], "ips": LOOSE_IP},
        "local_ips": True, "domains_of": ("emails", "urls"), "skip_endings": (),
    },
    "code": {
        "patterns": {
            "urls": QUOTED_URL, "ips": LOOSE_IP, "file_paths": r"""[A-Za-z]:\\[^'"\s]+|/(?:etc|var|usr|opt|home)/[^'"\s]+""",
            "emails": r"[\w.-]+@[\w.-]+\.\w+",
        },
        "local_ips": False, "domains_of": ("urls",), "skip_endings": (),
    },
    "database": {
        "patterns": {"urls": QUOTED_URL, "ips": LOOSE_IP, "emails": r"[\w.-]+@[\w.-]+\.\w+", "hashes": DIGESTS},
        "local_ips": True, "domains_of": ("urls",), "skip_endings": (),
    },
    "registry": {
        "patterns": {
            "file_paths": r"(?i)[A-Za-z]:\\[^\\/:*?\"<>|\r\n]+(?:\\[^\\/:*?\"<>|\r\n]+)*\.(?:exe|dll|bat|cmd|ps1|vbs)", "urls": r"https?://[^\s]+",
            "ips": LOOSE_IP, "hashes": DIGESTS,
        },
        "local_ips": True, "domains_of": ("urls",), "skip_endings": (),
    },
}


def extract_variant(df: DataFrame, variant: str, text: str = "message", keep: Sequence[str] = ("entry_id", "file_id")) -> DataFrame:
    """Indicators by the rules of one kind of source."""
    spec = VARIANTS[variant]
    found = extract(df, F.col(text), spec["patterns"], keep).withColumnRenamed("kind", "ioc_type")
    value, kind = F.col("ioc_value"), F.col("ioc_type")
    kept = F.lit(True)
    if not spec["local_ips"]:
        local = F.lit(False)
        for prefix in (*LOCAL_PREFIXES, "0."):
            local = local | value.startswith(prefix)
        kept = ~((kind == "ips") & (local | ~net.is_ipv4(value)))
    for ending in spec["skip_endings"]:
        kept = kept & ~((kind == "domains") & value.endswith(ending))
    rows = found.where(kept).withColumn("ioc_value", F.when(kind.isin("emails", "hashes"), F.lower(value)).otherwise(value))
    if not spec["domains_of"]:
        return rows
    host = F.when(kind == "emails", net.email_domain(value)).when(kind == "urls", net.url_host(value))
    domains = rows.where(kind.isin(*spec["domains_of"])).select(*keep, F.lit("domains").alias("ioc_type"), host.alias("ioc_value"))
    return rows.unionByName(domains.where("ioc_value <> ''").distinct())


def sensor_iocs(events: DataFrame, keep: Sequence[str] = ("uid",)) -> DataFrame:
    """Public addresses, names, digests and suspicious URLs of sensor events, with their confidence."""
    have = set(events.columns)
    suspicious = F.size("suspicious") > 0
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")
    ioc = lambda kind, value, trust: F.struct(F.lit(kind).alias("ioc_type"), value.alias("ioc_value"), trust.alias("confidence"))
    high, by_flag = F.lit("high"), F.when(suspicious, "high").otherwise("medium")
    found = [F.when(net.is_public_ip(text(n)), ioc("ip", text(n), high)) for n in ("source_ip", "dest_ip") if n in have]
    found += [F.when(~text(n).isin("", "-"), ioc("domain", text(n), by_flag)) for n in ("host", "server_name", "query") if n in have]
    found += [F.when(~text(n).isin("", "-"), ioc(n, text(n), high)) for n in ("md5", "sha1", "sha256") if n in have]
    if {"host", "uri"} <= have:
        url = F.concat(F.lit("http://"), text("host"), text("uri"))
        found.append(F.when(suspicious & (text("uri") != "") & (text("host") != ""), ioc("url", url, high)))
    rows = explode_computed(events, keep, F.array_distinct(F.array_compact(F.array(*found))), "_i")
    return rows.select(*keep, "_i.*")

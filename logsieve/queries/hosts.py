"""Registry, process, string, file, archive, document and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import hostscan, tablescan
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.readers import REGISTRY_SQL, registry_lines
from logsieve.queries.registry import query
from logsieve.sources import registry


def registry_values(spark, sf_dir):
    return registry.registry_entries(registry_lines(spark, sf_dir))


KEY_ROWS = [[k, v] for k, v in hostscan.PERSISTENCE_KEYS.items()]


@query(
    "registry_persistence",
    s.with_ctes(
        "messages",
        REGISTRY_SQL + f""", pk AS {s.values(KEY_ROWS, 'part', 'persistence_type')} SELECT file_id, line_no, value_name, persistence_type FROM re JOIN pk ON contains(lower(key_path), lower(part))
        WHERE event_type = 'registry_value'""",
    ),
)
def registry_persistence(spark, sf_dir):
    found = hostscan.registry_persistence(registry_values(spark, sf_dir), ["file_id", "line_no"])
    return found.select("file_id", "line_no", "value_name", "persistence_type")


SUSPICIOUS_SQL = REGISTRY_SQL + ", sv AS (" + " UNION ALL ".join(
    f"SELECT file_id, line_no, key_path, '{n}' AS reason, '{'critical' if n == 'encoded_command' else 'warning'}' AS severity FROM re WHERE event_type = 'registry_value' AND regexp_matches(value_data, {s.text(p)})"
    for n, p in hostscan.VALUE_PATTERNS.items()
) + ")"


def registry_hits(spark, sf_dir):
    return hostscan.registry_suspicious(registry_values(spark, sf_dir), ["file_id", "line_no"])


@query("registry_suspicious", s.with_ctes("messages", SUSPICIOUS_SQL + " SELECT * FROM sv"))
def registry_suspicious(spark, sf_dir):
    return registry_hits(spark, sf_dir)


@query(
    "registry_top_keys",
    s.with_ctes("messages", SUSPICIOUS_SQL + " SELECT key_path, count(*) AS hits, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM sv GROUP BY 1 ORDER BY hits DESC, key_path LIMIT 10"),
)
def registry_top_keys(spark, sf_dir):
    return hostscan.registry_top_keys(registry_hits(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query("registry_pattern_counts", s.with_ctes("messages", SUSPICIOUS_SQL + " SELECT reason, count(*) AS hits FROM sv GROUP BY 1"))
def registry_pattern_counts(spark, sf_dir):
    return hostscan.registry_pattern_counts(registry_hits(spark, sf_dir))


def processes(spark, sf_dir):
    k = F.col("k")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k % len(xs) + 1)
    return adapt.messages(spark, sf_dir).select(
        "entry_id", F.col("line_no").alias("pid"), pick("lsass.exe", "csrss.exe", "app.exe", "my app.exe").alias("name"), (k % 5).alias("ppid"),
        pick("10.0.0.1:4444", "10.0.0.1:443", "host").alias("address"), pick("hook.dll", "kernel32.dll", "deadbeef01.dll").alias("dll"),
        pick("powershell -enc AAAA", "notepad", "certutil -decode a b", "net user x /add").alias("command_line"), pick("C:\\Temp\\a.exe", "C:\\a.exe").alias("file_path"),
    )


@query(
    "process_flags",
    s.with_ctes(
        "messages",
        """SELECT entry_id, concat_ws(',', CASE WHEN k % 4 IN (0, 3) OR (k % 4 = 1 AND k % 5 <> 4) THEN 'suspicious_process' END, CASE WHEN k % 3 = 0 THEN 'suspicious_connection' END,
        CASE WHEN k % 3 IN (0, 2) THEN 'suspicious_dll' END, CASE WHEN k % 4 IN (0, 2, 3) THEN 'suspicious_command_line' END, CASE WHEN k % 2 = 0 THEN 'suspicious_file' END) AS reasons FROM messages""",
    ),
)
def process_flags(spark, sf_dir):
    return hostscan.process_flags(processes(spark, sf_dir)).select("entry_id", F.array_join("reasons", ",").alias("reasons"))


@query("hidden_processes", "SELECT o_orderkey AS pid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def hidden_processes(spark, sf_dir):
    scanned = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"))
    listed = adapt.table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("pid"))
    return hostscan.hidden_processes(scanned, listed)


GROUPS = [[g, p] for g, ps in hostscan.API_GROUPS.items() for p in ps]


@query(
    "string_indicators",
    s.with_ctes(
        "entries",
        f""", g AS {s.values(GROUPS, 'indicator', 'pattern')}, n AS {s.values([[p] for p in hostscan.PROCESS_NAMES], 'pattern')},
        d AS (SELECT DISTINCT message AS text FROM entries), h AS (SELECT text, indicator, pattern FROM d JOIN g ON contains(lower(text), lower(pattern))
        UNION ALL SELECT text, 'process_path', pattern FROM d JOIN n ON contains(text, pattern) WHERE contains(text, '\\') OR contains(text, '/'))
        SELECT md5(text) AS text_md5, indicator, pattern FROM h""".replace("\\\\", "\\"),
    ),
)
def string_indicators(spark, sf_dir):
    lines = adapt.entries(spark, sf_dir).select(F.col("message").alias("text"))
    return hostscan.string_indicators(lines).select(F.md5("text").alias("text_md5"), "indicator", "pattern")


PATHS = (
    "C:\\Windows\\System32\\config\\SAM", "C:\\Users\\a\\AppData\\Local\\Temp\\x.ps1", "C:\\docs\\README_DECRYPT.txt", "C:\\data\\a.locked", "/home/u/.bash_history",
    "C:\\$Recycle.Bin\\z", "C:\\Windows\\Prefetch\\CMD.pf", "C:\\plain\\file.doc",
    "c:\\windows\\temp\\x.exe", "C:\\data\\A.LOCKED",
)


@query(
    "artefact_paths",
    s.with_ctes(
        "messages",
        f""", p AS (SELECT entry_id, [{', '.join(s.text(p) for p in PATHS)}][k % {len(PATHS)} + 1] AS path FROM messages) """
        + " UNION ALL ".join(
            f"SELECT entry_id, '{kind}' AS kind, '{n}' AS name FROM p WHERE regexp_matches(path, {s.text(r)}, 'i')"
            for kind, table in (("artefact", hostscan.ARTEFACTS), ("suspicious", hostscan.SUSPICIOUS_FILES))
            for n, r in table.items()
        ),
    ),
)
def artefact_paths(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), F.col("k") % len(PATHS) + 1)
    return hostscan.artefact_paths(adapt.messages(spark, sf_dir).select("entry_id", path.alias("path")), ["entry_id"])


NAMES = ("setup.exe", "report.pdf.js", "dir/.hidden", "crack_tool.txt", "photo.jpg", "backdoor.ps1")


def members(spark, sf_dir):
    k = F.col("k")
    return adapt.messages(spark, sf_dir).select(
        "entry_id", "source", F.element_at(F.array(*[F.lit(n) for n in NAMES]), k % len(NAMES) + 1).alias("name"), (k * 1000).alias("size"),
        F.when(k % 4 == 0, k).otherwise(k * 500).alias("compressed_size"),
    )


MEMBERS_SQL = f""", ar AS (SELECT entry_id, source, [{', '.join(s.text(n) for n in NAMES)}][k % {len(NAMES)} + 1] AS name, k * 1000 AS size, CASE WHEN k % 4 = 0 THEN k ELSE k * 500 END AS packed FROM messages),
    am AS (SELECT *, concat_ws('|', CASE name WHEN 'setup.exe' THEN 'Executable extension: .exe' WHEN 'report.pdf.js' THEN 'Executable extension: .js' WHEN 'backdoor.ps1' THEN 'Executable extension: .ps1' END,
      CASE name WHEN 'crack_tool.txt' THEN 'Suspicious name pattern: crack' WHEN 'backdoor.ps1' THEN 'Suspicious name pattern: backdoor' END,
      CASE name WHEN 'report.pdf.js' THEN 'Double extension' END, CASE name WHEN 'dir/.hidden' THEN 'Hidden file' END,
      CASE WHEN size > 0 AND packed / size < 0.01 THEN 'Unusual compression ratio' END) AS reasons FROM ar)"""


@query("archive_members", s.with_ctes("messages", MEMBERS_SQL + " SELECT entry_id, name, reasons FROM am"))
def archive_members(spark, sf_dir):
    return hostscan.archive_members(members(spark, sf_dir)).select("entry_id", "name", F.array_join("reasons", "|").alias("reasons"))


@query(
    "archive_summary",
    s.with_ctes(
        "messages",
        MEMBERS_SQL + """ SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(packed) AS BIGINT) AS compressed_size, count(*) FILTER (reasons <> '') AS suspicious_files,
        round(sum(packed) / sum(size), 6) AS ratio FROM am GROUP BY 1""",
    ),
)
def archive_summary(spark, sf_dir):
    return rounded(hostscan.archive_summary(members(spark, sf_dir), "source"))


@query(
    "archive_member_types",
    s.with_ctes("messages", MEMBERS_SQL + r" SELECT source, lower(regexp_extract(name, '(\.[^./\\]+)$', 1)) AS extension, count(*) AS files FROM ar GROUP BY 1, 2"),
)
def archive_member_types(spark, sf_dir):
    return hostscan.member_types(members(spark, sf_dir), "source")


MARK_SQL = {
    kind: " + ".join(f"CAST(regexp_matches(html, {s.text(p)}) AS INTEGER)" for p in patterns)
    for kind, patterns in hostscan.DOCUMENT_MARKS.items()
}
EVAL, UNESCAPE, NO_LETTERS = s.text(r"eval\s*\("), s.text(r"unescape\s*\("), s.text(r"[^\pL\pN]")


@query(
    "document_marks",
    f"""WITH d AS (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN ' eval(unescape(x)); getURL(y)' WHEN 1 THEN ' util.printf("%45000f", n); app.alert(1)' ELSE '' END AS html FROM pages),
    c AS (SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in MARK_SQL.items())},
      CAST(regexp_matches(html, {EVAL}) AS INTEGER) + CAST(regexp_matches(html, {UNESCAPE}) AS INTEGER) + CAST(contains(html, 'replace') AND contains(html, 'function') AS INTEGER)
      + CAST(length(regexp_replace(html, {NO_LETTERS}, '', 'g')) / greatest(length(html), 1) < 0.3 AS INTEGER) >= 2 AS obfuscated FROM d),
    p AS (SELECT *, CASE WHEN javascript > 0 THEN 20 ELSE 0 END + CASE WHEN suspicious_api > 0 THEN 20 ELSE 0 END + CASE WHEN shellcode > 0 THEN 50 ELSE 0 END + CASE WHEN exploit > 0 THEN 50 ELSE 0 END
      + CASE WHEN obfuscated THEN 30 ELSE 0 END AS threat_points FROM c)
    SELECT *, CASE WHEN threat_points >= 150 THEN 'CRITICAL' WHEN threat_points >= 100 THEN 'HIGH' WHEN threat_points >= 50 THEN 'MEDIUM' WHEN threat_points >= 20 THEN 'LOW' ELSE 'SAFE' END AS threat_level FROM p""",
)
def document_marks(spark, sf_dir):
    slot = F.col("page_id") % 3
    more = F.when(slot == 0, " eval(unescape(x)); getURL(y)").when(slot == 1, ' util.printf("%45000f", n); app.alert(1)').otherwise("")
    texts = adapt.table(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("text"))
    return hostscan.document_marks(texts, ["page_id"])


def named_tables(spark, sf_dir):
    customers = adapt.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("username"), F.concat(F.lit("pw"), F.col("c_custkey").cast("string")).alias("password"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 9 == 0, "4111111111111111").alias("credit_card"),
    )
    logs = adapt.messages(spark, sf_dir).select("message", "source")
    return {"app_users": customers, "sys_logs": logs}


@query(
    "sensitive_data",
    s.with_ctes(
        "messages",
        """SELECT 'app_users' AS "table", 'username' AS "column", count(*) AS "values", 'warning' AS severity, 'sensitive' AS tag FROM customer
        UNION ALL SELECT 'app_users', 'password', count(*), 'critical', 'plaintext_password' FROM customer
        UNION ALL SELECT 'app_users', 'credit_card', count(*), 'critical', 'payment_card' FROM customer WHERE c_custkey % 9 = 0
        UNION ALL SELECT 'sys_logs', 'message', count(*), 'warning', 'sensitive' FROM messages""",
    ),
)
def sensitive_data(spark, sf_dir):
    return tablescan.sensitive_data(named_tables(spark, sf_dir)).drop("masked_sample")


VALUES_SQL = ", tv AS (SELECT 'sys_logs' AS \"table\", 'message' AS \"column\", CASE " + " ".join(
    f"WHEN regexp_matches(message, {s.text(p)}) THEN '{n}'" for n, p in tablescan.VALUE_PATTERNS.items()
) + """ END AS pattern FROM messages), th AS (SELECT "table", "column", pattern, count(*) AS hits, CASE WHEN pattern IN ('c2_urls', 'crypto_wallet') THEN 'critical' ELSE 'warning' END AS severity FROM tv
    WHERE pattern IS NOT NULL GROUP BY 1, 2, 3)"""


@query("suspicious_values", s.with_ctes("messages", VALUES_SQL + " SELECT * FROM th"))
def suspicious_values(spark, sf_dir):
    return tablescan.suspicious_values(named_tables(spark, sf_dir))


@query(
    "table_risk",
    s.with_ctes(
        "messages",
        VALUES_SQL + """, x AS (SELECT CAST(sum(hits) AS BIGINT) AS suspicious_values, 4 AS sensitive_columns, CAST(50 + 8 + sum(hits) * 5 AS BIGINT) AS risk_score FROM th)
        SELECT *, CASE WHEN risk_score >= 100 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM x""",
    ),
)
def table_risk(spark, sf_dir):
    tables = named_tables(spark, sf_dir)
    return tablescan.table_risk(tablescan.sensitive_data(tables), tablescan.suspicious_values(tables))

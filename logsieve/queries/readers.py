"""Parsers over lines and records that Spark makes from the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import text as txt
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query
from logsieve.session import shared_path
from logsieve.sources import csvlogs, inventory, jsonlogs, logcat, parsers, registry, text

ST = "strftime(ts, '{}')"


def raw_lines(spark, sf_dir):
    """Events written as five kinds of log line."""
    ts, k = F.col("ts"), F.col("k")
    day = lambda fmt: F.date_format(ts, fmt)
    ks, user = k.cast("string"), F.col("user")
    status = F.when(k % 3 == 0, "200").when(k % 3 == 1, "404").otherwise("503")
    slot = F.col("line_no") % 5
    line = (
        F.when(slot == 0, F.concat(day("yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("message")))
        .when(slot == 1, F.concat(day("MMM dd HH:mm:ss"), F.lit(" "), F.col("source"), F.lit(" "), F.col("message")))
        .when(
            slot == 2,
            F.concat(F.lit("10.0.0."), ks, F.lit(" - - ["), day("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /p/'), ks, F.lit(' HTTP/1.1" '), status, F.lit(" 512")),
        )
        .when(slot == 3, F.concat(F.lit("com.app."), user, F.lit("Exception: code "), ks))
        .otherwise(F.concat(F.lit("note "), F.col("message")))
    )
    return adapt.messages(spark, sf_dir).select("entry_id", "file_id", "line_no", line.alias("line"))


LINES_SQL = """, ln AS (SELECT *, line_no % 5 AS slot, CASE k % 3 WHEN 0 THEN '200' WHEN 1 THEN '404' ELSE '503' END AS status FROM messages)"""


def _lift(base, line):
    return f"CASE WHEN {s.matched(line, txt.SECURITY_PATTERNS)} <> '' THEN 'high' ELSE {base} END"


def _sev(column):
    return s.first_class(column, txt.SEVERITY_WORDS, "info")


@query(
    "text_log_lines",
    s.with_ctes(
        "messages",
        LINES_SQL + f""" SELECT entry_id, CASE slot WHEN 0 THEN 'iso_timestamp' WHEN 1 THEN 'syslog_like' WHEN 2 THEN 'access_log' WHEN 3 THEN 'java_exception' ELSE 'none' END AS pattern_type,
        CASE slot WHEN 1 THEN source WHEN 2 THEN '10.0.0.' || k WHEN 3 THEN 'application' ELSE 'text_file' END AS source,
        CASE slot WHEN 0 THEN 'generic_log' WHEN 1 THEN 'system_log' WHEN 2 THEN 'web_access' WHEN 3 THEN 'application_error'
             ELSE {s.first_class("'note ' || message", txt.EVENT_TYPE_WORDS['text'], 'generic_log')} END AS event_type,
        CASE slot WHEN 2 THEN CASE WHEN status = '200' THEN 'info' ELSE 'high' END WHEN 3 THEN 'high' ELSE {_lift(_sev('message'), 'message')} END AS severity,
        CASE slot WHEN 2 THEN 'GET /p/' || k || ' - ' || status WHEN 3 THEN 'com.app.' || "user" || 'Exception: code ' || k WHEN 4 THEN 'note ' || message ELSE message END AS message,
        CASE WHEN slot <= 2 THEN epoch_us(ts) // 1000000 WHEN slot = 4 AND k % 20 = 16 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05') // 1000000 ELSE -1 END AS at_s FROM ln""",
    ),
)
def text_log_lines(spark, sf_dir):
    found = text.parse_lines(raw_lines(spark, sf_dir), year=2024)
    return found.select(
        "entry_id", F.coalesce("pattern_type", F.lit("none")).alias("pattern_type"), "source", "event_type", "severity", "message",
        F.coalesce(F.unix_seconds("ts"), F.lit(-1)).alias("at_s"),
    )


@query(
    "access_log",
    s.with_ctes(
        "messages",
        LINES_SQL + """ SELECT entry_id, '10.0.0.' || k AS ip, 'GET' AS method, '/p/' || k AS path, 'HTTP/1.1' AS protocol, CAST(status AS INTEGER) AS status, 512 AS size,
        CASE WHEN status = '200' THEN 'info' ELSE 'high' END AS severity, epoch_us(ts) // 1000000 AS at_s FROM ln WHERE slot = 2""",
    ),
)
def access_log(spark, sf_dir):
    found = text.access_log(raw_lines(spark, sf_dir))
    return found.select("entry_id", "ip", "method", "path", "protocol", "status", "size", "severity", F.unix_seconds("ts").alias("at_s"))


TRACE_LINES = (
    "com.shop.PaymentException: bad", "\tat com.shop.Pay.run", "\tat com.shop.Main.main", "Traceback (most recent call last):",
    '  File "a.py", line 3', "ValueError: wrong", "plain line",
)


def trace_lines(spark, sf_dir):
    k = F.col("k")
    pick = F.element_at(F.array(*[F.lit(t) for t in TRACE_LINES]), k % len(TRACE_LINES) + 1)
    return adapt.messages(spark, sf_dir).select(F.col("source").alias("file_id"), F.col("line_no"), pick.alias("line"))


TRACES_SQL = f""", tl AS (SELECT source AS file_id, row_number() OVER (PARTITION BY source ORDER BY line_no) AS line_no, k % {len(TRACE_LINES)} AS c FROM messages),
    o AS (SELECT *, last_value(CASE WHEN c NOT IN (1, 2) THEN line_no * 10 + c END IGNORE NULLS) OVER w AS oj,
          last_value(CASE WHEN c NOT IN (4, 5) THEN line_no * 10 + c END IGNORE NULLS) OVER w AS op FROM tl
          WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    m AS (SELECT file_id, line_no, c, CASE WHEN c IN (0, 3) THEN line_no WHEN c IN (1, 2) AND oj % 10 = 0 THEN oj // 10 WHEN c IN (4, 5) AND op % 10 = 3 THEN op // 10 END AS blk FROM o)"""


@query(
    "stitch_multiline",
    s.with_ctes(
        "messages",
        TRACES_SQL + """ SELECT file_id, blk AS line_no, CASE WHEN min(c) = 0 THEN 'java_exception' ELSE 'python_exception' END AS event_type, count(*) AS lines,
        CASE WHEN min(c) = 0 THEN 'Java Exception: com.shop.PaymentException' WHEN max(c) = 5 THEN 'ValueError: wrong' ELSE 'Python Traceback' END AS message
        FROM m WHERE blk IS NOT NULL GROUP BY 1, 2""",
    ),
)
def stitch_multiline(spark, sf_dir):
    from logsieve.operators.ordered import row_index

    numbered = row_index(
        trace_lines(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("line_no"))), ["file_id"], ["line_no"], segment_seconds=2000
    ).select("file_id", (F.col("row_index") + 1).alias("line_no"), "line")
    return text.stitch_multiline(numbered).drop("severity", "raw_data")


@query(
    "csv_entries",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, epoch_us(date_trunc('second', ts)) // 1000000 AS at_s, source,
        CASE WHEN {s.first_class('event_type', txt.CSV_ACTION_WORDS, '')} <> '' THEN {s.first_class('event_type', txt.CSV_ACTION_WORDS, '')} ELSE
          {s.first_class("source || ' 10.1.1.' || k || ' ' || \"user\" || ' ' || message || ' ' || level || ' ' || event_type", txt.EVENT_TYPE_WORDS['csv'], 'generic_event')} END AS event_type,
        CASE level WHEN 'error' THEN 'high' ELSE 'info' END AS severity, message, "user" AS users, '10.1.1.' || k AS ips FROM messages""",
    ),
)
def csv_entries(spark, sf_dir):
    rows = adapt.messages(spark, sf_dir).select(
        "entry_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("log_time"), F.col("source").alias("host"),
        F.concat(F.lit("10.1.1."), F.col("k").cast("string")).alias("ip"), F.col("user").alias("login"), F.col("message").alias("msg"),
        F.col("level").alias("severity"), F.col("event_type").alias("command"),
    )
    found = csvlogs.csv_entries(rows, keep=["entry_id"])
    return found.select(
        "entry_id", F.unix_seconds("ts").alias("at_s"), "source", "event_type", "severity", "message",
        F.array_join("users", ",").alias("users"), F.array_join("ip_addresses", ",").alias("ips"),
    )


def json_records(spark, sf_dir):
    """Events written as records of four dialects."""
    k, ts = F.col("k"), F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cloud = F.to_json(
        F.struct(
            iso.alias("eventTime"), F.when(k % 2 == 0, "DeleteUser").otherwise("ListUsers").alias("eventName"), F.lit("iam").alias("eventSource"),
            F.struct(F.col("user").alias("userName")).alias("userIdentity"), F.when(k % 3 == 0, "AccessDenied").alias("errorCode"),
        )
    )
    search = F.to_json(
        F.struct(F.lit("idx").alias("_index"), F.struct(iso.alias("@timestamp"), F.col("source").alias("host"), F.col("message")).alias("_source"))
    )
    splunk = F.to_json(F.struct(F.unix_seconds(ts).alias("_time"), F.col("message").alias("_raw"), F.col("source").alias("source")))
    generic = F.to_json(F.struct(F.unix_seconds(ts).alias("time"), F.col("event_type").alias("event_kind"), F.col("user").alias("src"), F.lit("x").alias("other")))
    return adapt.messages(spark, sf_dir).select(
        "entry_id", F.when(k % 4 == 0, cloud).when(k % 4 == 1, search).when(k % 4 == 2, splunk).otherwise(generic).alias("object")
    )


OBJ = """CASE k % 4 WHEN 1 THEN '{"@timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","host":"' || source || '","message":"' || replace(message, '\\', '\\\\') || '"}'
    ELSE '{"time":' || (us // 1000000) || ',"event_kind":"' || event_type || '","src":"' || "user" || '","other":"x"}' END"""


@query(
    "json_entries",
    s.with_ctes(
        "messages",
        f""", j AS (SELECT *, {OBJ} AS obj FROM messages)
        SELECT entry_id, CASE k % 4 WHEN 0 THEN 'cloudtrail' WHEN 1 THEN 'elasticsearch' WHEN 2 THEN 'splunk' ELSE 'generic' END AS dialect,
        us // 1000000 AS at_s, CASE k % 4 WHEN 0 THEN 'iam' WHEN 3 THEN "user" ELSE source END AS source,
        CASE k % 4 WHEN 0 THEN 'cloud_audit' WHEN 2 THEN 'log_aggregation' ELSE {s.first_class('obj', txt.EVENT_TYPE_WORDS['json'], 'generic_event')} END AS event_type,
        CASE k % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'high' WHEN k % 2 = 0 THEN 'medium' ELSE 'info' END WHEN 2 THEN {_sev('message')}
           ELSE {s.first_class('obj', txt.OBJECT_SEVERITY_WORDS, 'info')} END AS severity,
        CASE k % 4 WHEN 0 THEN 'AWS ' || CASE WHEN k % 2 = 0 THEN 'DeleteUser' ELSE 'ListUsers' END || ' by ' || "user" WHEN 3 THEN 'event_kind=' || event_type ELSE message END AS message
        FROM j""",
    ),
)
def json_entries(spark, sf_dir):
    found = jsonlogs.json_entries(json_records(spark, sf_dir), keep=["entry_id"])
    return found.select("entry_id", "dialect", F.unix_seconds("ts").alias("at_s"), "source", "event_type", "severity", "message")


@query(
    "json_objects",
    """SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(1 + CAST(doc_id % 4 AS BIGINT))) FROM documents) GROUP BY 1""",
)
def json_objects(spark, sf_dir):
    """Documents wrapped as an array, two kinds of envelope, or a bare object, and taken apart again."""
    n = F.col("doc_id") % 4
    item = F.to_json(F.struct(F.col("lang"), F.col("source")))
    items = F.array_join(F.array_repeat(item, (n + 1).cast("int")), ",")
    text_ = (
        F.when(n == 1, F.concat(F.lit("["), items, F.lit("]"))).when(n == 2, F.concat(F.lit('{"meta":1,"events":['), items, F.lit("]}")))
        .when(n == 3, F.concat(F.lit('{"weird":['), items, F.lit("]}"))).otherwise(item)
    )
    df = adapt.table(spark, sf_dir, "documents").select("doc_id", text_.alias("text"))
    return jsonlogs.objects(df, keep=["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_metadata",
    """SELECT doc_id, lang AS a, 'in-' || source AS b, '["x","y"]' AS c, 3 AS n FROM documents""",
)
def json_metadata(spark, sf_dir):
    obj = F.to_json(
        F.struct(
            F.col("lang"), F.struct(F.concat(F.lit("in-"), "source").alias("place"), F.struct(F.lit(1).alias("z")).alias("deep")).alias("inner"),
            F.array(F.lit("x"), F.lit("y")).alias("list"),
        )
    )
    df = adapt.table(spark, sf_dir, "documents").select("doc_id", obj.alias("o")).withColumn("m", jsonlogs.metadata(F.col("o")))
    return df.select(
        "doc_id", F.col("m")["lang"].alias("a"), F.col("m")["inner.place"].alias("b"), F.col("m")["list"].alias("c"), F.size("m").alias("n")
    )


@query(
    "logcat_entries",
    s.with_ctes(
        "messages",
        """SELECT entry_id, CASE k % 3 WHEN 0 THEN 'threadtime' WHEN 1 THEN 'time' ELSE 'brief' END AS format, CASE WHEN k % 3 < 2 THEN us // 1000000 ELSE -1 END AS at_s, file_id AS pid,
        CASE level WHEN 'error' THEN 'error' ELSE 'info' END AS severity, 'Tag' || k AS tag, message FROM messages""",
    ),
)
def logcat_entries(spark, sf_dir):
    k = F.col("k")
    level = F.when(F.col("level") == "error", "E").otherwise("I")
    stamp = F.date_format("ts", "MM-dd HH:mm:ss.SSS")
    pid, tag = F.col("file_id").cast("string"), F.concat(F.lit("Tag"), k.cast("string"))
    line = (
        F.when(k % 3 == 0, F.concat(stamp, F.lit("  "), pid, F.lit("  77 "), level, F.lit(" "), tag, F.lit(": "), F.col("message")))
        .when(k % 3 == 1, F.concat(stamp, F.lit(" "), level, F.lit("/"), tag, F.lit("( "), pid, F.lit("): "), F.col("message")))
        .otherwise(F.concat(level, F.lit("/"), tag, F.lit("("), pid, F.lit("): "), F.col("message")))
    )
    found = logcat.logcat_entries(adapt.messages(spark, sf_dir).select("entry_id", line.alias("line")), 2024)
    return found.select("entry_id", "format", F.coalesce(F.unix_seconds("ts"), F.lit(-1)).alias("at_s"), "pid", "severity", "tag", "message")


def registry_lines(spark, sf_dir):
    k = F.col("k")
    ks = k.cast("string")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("[HKEY_LOCAL_MACHINE\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run"), ks, F.lit("]")))
        .when(k % 5 == 1, F.concat(F.lit("[-HKEY_CURRENT_USER\\Old"), ks, F.lit("]")))
        .when(k % 5 == 2, F.concat(F.lit('"dw"=dword:000000'), ks))
        .otherwise(F.concat(F.lit('"n'), ks, F.lit('"="C:\\\\Temp\\\\a'), ks, F.lit('.exe"')))
    )
    return adapt.messages(spark, sf_dir).select(F.col("source").alias("file_id"), "line_no", line.alias("line"))


REGISTRY_SQL = r""", rl AS (SELECT source AS file_id, line_no, k, CASE k % 5 WHEN 0 THEN 'HKEY_LOCAL_MACHINE\SOFTWARE\Microsoft\Windows\CurrentVersion\Run' || k WHEN 1 THEN 'HKEY_CURRENT_USER\Old' || k END AS ky FROM messages),
    rg AS (SELECT *, last_value(ky IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key_path FROM rl),
    re AS (SELECT file_id, line_no, CASE k % 5 WHEN 0 THEN 'registry_key' WHEN 1 THEN 'registry_delete' ELSE 'registry_value' END AS event_type, key_path,
      CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'dw' ELSE 'n' || k END AS value_name,
      CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'dword:000000' || k ELSE 'C:\Temp\a' || k || '.exe' END AS value_data FROM rg WHERE key_path IS NOT NULL)"""


@query("registry_entries", s.with_ctes("messages", REGISTRY_SQL + " SELECT * FROM re"))
def registry_entries(spark, sf_dir):
    found = registry.registry_entries(registry_lines(spark, sf_dir))
    return found.select(
        "file_id", "line_no", "event_type", "key_path", F.coalesce("value_name", F.lit("")).alias("value_name"),
        F.coalesce("value_data", F.lit("")).alias("value_data"),
    )


EXTENSION_ROWS = [[e, k, c] for c, t in inventory.KINDS_BY_CATEGORY.items() for e, k in t.items()]


@query(
    "file_inventory",
    f"""WITH m AS {s.values(EXTENSION_ROWS, 'ext', 'kind0', 'cat0')},
    d AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'pcap' WHEN 1 THEN 'LOG' WHEN 2 THEN 'weird' WHEN 3 THEN 'ps1' ELSE '' END AS e FROM documents),
    x AS (SELECT doc_id, lower(e) AS extension, CASE """
    + " ".join(f"WHEN regexp_matches(substr(text, 1, 8192), {s.text(p)}) THEN '{k}|{c}'" for p, k, c in inventory.CONTENT)
    + """ END AS by_content, NOT regexp_matches(substr(text, 1, 8192), '[\\x00-\\x08\\x0E-\\x1F]') AS is_text FROM d)
    SELECT doc_id, extension, coalesce(kind0, CASE WHEN is_text THEN split_part(by_content, '|', 1) END, CASE WHEN is_text THEN 'text' ELSE 'binary' END) AS kind,
      coalesce(cat0, CASE WHEN is_text THEN split_part(by_content, '|', 2) END, 'generic') AS category,
      CASE WHEN kind0 IS NOT NULL THEN 0.9 WHEN is_text AND by_content IS NOT NULL THEN 0.7 WHEN is_text THEN 0.5 ELSE 0.3 END AS confidence
    FROM x LEFT JOIN m ON ext = extension""".replace("\\\\", "\\"),
)
def file_inventory(spark, sf_dir):
    slot = F.col("doc_id") % 5
    ending = F.when(slot == 0, ".pcap").when(slot == 1, ".LOG").when(slot == 2, ".weird").when(slot == 3, ".ps1").otherwise("")
    files = adapt.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/data/f"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("text").alias("head")
    )
    return inventory.identify(files).select("doc_id", "extension", "kind", "category", "confidence")


NORMAL = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g')"


@query(
    "exact_duplicates",
    f"SELECT sha256({NORMAL}) AS hash, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def exact_duplicates(spark, sf_dir):
    return inventory.exact_duplicates(adapt.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("distinct_documents", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORMAL}")
def distinct_documents(spark, sf_dir):
    return inventory.drop_exact_duplicates(adapt.table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


@query(
    "parse_stats",
    s.with_ctes(
        "messages",
        LINES_SQL + """ SELECT file_id, count(*) AS total, count(*) FILTER (slot < 4) AS parsed, count(*) FILTER (slot = 4) AS failed,
        count(*) FILTER (slot = 3 OR (slot = 4 AND k % 20 <> 16)) AS without_time FROM ln GROUP BY 1""",
    ),
)
def parse_stats(spark, sf_dir):
    parsed = text.parse_lines(raw_lines(spark, sf_dir), year=2024)
    return inventory.parse_stats(parsed, ok=~F.col("unstructured")).drop("first_ts", "last_ts")


FOLDERS = {",": "comma", "\t": "tab", "|": "bar", ";": "semicolon", ":": "colon"}


@query(
    "csv_folders",
    s.with_ctes(
        "messages",
        f"""SELECT line_no, CASE k % 5 WHEN 4 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000000 END AS at_s, CASE WHEN k % 5 IN (1, 3) THEN '10.1.1.' || k ELSE source END AS source,
        CASE WHEN {s.first_class('event_type', txt.CSV_ACTION_WORDS, '')} <> '' THEN {s.first_class('event_type', txt.CSV_ACTION_WORDS, '')} ELSE
          {s.first_class("event_type || ' ' || \"user\" || ' ' || source || ' ' || level", txt.EVENT_TYPE_WORDS['csv'], 'generic_event')} END AS event_type,
        CASE level WHEN 'error' THEN 'high' ELSE 'info' END AS severity, "user" AS users, '10.1.1.' || k AS ips FROM messages""",
    ),
)
def csv_folders(spark, sf_dir):
    """Events written as files of five delimiters and two headers, read back as one table."""
    folder = shared_path(spark, "csv-folders")
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("log_time")
    ip = F.concat(F.lit("10.1.1."), F.col("k").cast("string")).alias("ip")
    rest = [ip, F.col("user").alias("login"), F.col("event_type").alias("command"), F.col("level").alias("severity"), F.col("line_no").alias("line")]
    for n, (sep, name) in enumerate(FOLDERS.items()):
        rows = adapt.messages(spark, sf_dir).where(F.col("k") % 5 == n)
        columns = [day, *rest, F.col("source").alias("host")] if n % 2 == 0 else [*rest, day, F.col("source").alias("place")]
        if sep == ":":  # times hold colons
            columns = columns[1:]
        rows.select(*columns).write.csv(f"{folder}/{name}", sep=sep, header=True)
    found = csvlogs.read_csv_logs(spark, f"{folder}/*")
    return found.select(
        F.col("metadata.csv_line").cast("long").alias("line_no"), F.unix_seconds("ts").alias("at_s"), "source", "event_type", "severity",
        F.array_join("users", ",").alias("users"), F.array_join("ip_addresses", ",").alias("ips"),
    )


@query(
    "json_array_files",
    "SELECT event_id, user_id, event_type, props, event_id // 1000 AS chunk FROM events",
)
def json_array_files(spark, sf_dir):
    """Events written as JSON arrays, a thousand each, and read back by split."""
    folder = shared_path(spark, "json-arrays")
    events = adapt.table(spark, sf_dir, "events").withColumn("chunk", F.expr("event_id div 1000"))
    record = F.struct("event_id", F.to_json(F.struct("user_id", "event_type", "props")).alias("said"), F.array(F.struct("event_type", "chunk")).alias("more"))
    arrays = events.groupBy("chunk").agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.repartition("chunk").write.partitionBy("chunk").text(folder)
    o = F.col("object")
    said = F.get_json_object(o, "$.said")
    found = jsonlogs.read_objects(spark, f"{folder}/*/*.txt")
    return found.select(
        F.get_json_object(o, "$.event_id").cast("long").alias("event_id"), F.get_json_object(said, "$.user_id").cast("long").alias("user_id"),
        F.get_json_object(o, "$.more[0].event_type").alias("event_type"), F.get_json_object(said, "$.props").alias("props"),
        F.get_json_object(o, "$.more[0].chunk").cast("long").alias("chunk"),
    )


class NameValues:
    """A parser as a user would bring it: the fields of a JSON object, one row each."""

    def eval(self, text: str):
        try:
            found = json.loads(text or "")
        except ValueError:
            return
        if isinstance(found, dict):
            for name, value in found.items():
                yield name, str(value)


@query("user_parser_rows", "SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS field FROM events")
def user_parser_rows(spark, sf_dir):
    parsers.register_parser(spark, parsers.Parser("name_values", NameValues, "name string, field string", (".json",)))
    return parsers.parse_with(adapt.table(spark, sf_dir, "events").select("event_id", "props"), "name_values", "props").drop("props")

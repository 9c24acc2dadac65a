"""Distinct-partner detectors over flows and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import text
from logsieve.operators import fanout, sketches
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.buckets import is_outlier, outliers_sql
from logsieve.queries.registry import query


@query(
    "user_action_entropy",
    s.with_ctes(
        "log_events",
        """, c AS (SELECT "user", action, count(*) AS n FROM log_events GROUP BY 1, 2),
        p AS (SELECT *, n / sum(n) OVER (PARTITION BY "user") AS p FROM c)
        SELECT "user", count(*) AS action_count, round(-sum(p * log2(p)), 6) AS action_entropy, CAST(sum(n) AS BIGINT) AS total_actions
        FROM p GROUP BY 1 HAVING -sum(p * log2(p)) > 2.25""",
    ),
)
def user_action_entropy(spark, sf_dir):
    return rounded(fanout.user_action_entropy(adapt.log_events(spark, sf_dir), over=2.25))


@query(
    "count_entropy",
    s.with_ctes(
        "log_events",
        """, c AS (SELECT k, count(*) AS n FROM log_events GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c)
        SELECT round(-sum(p * log2(p)), 6) AS bits FROM p""",
    ),
)
def count_entropy(spark, sf_dir):
    from logsieve.operators.stats import entropy_of_counts

    return entropy_of_counts(adapt.log_events(spark, sf_dir), [], "k").select(F.round("entropy", 6).alias("bits"))


@query(
    "multi_source_users",
    s.with_ctes(
        "messages",
        'SELECT "user", count(DISTINCT k) AS sources, count(*) AS events FROM messages GROUP BY 1 HAVING count(DISTINCT k) > 40',
    ),
)
def multi_source_users(spark, sf_dir):
    return fanout.multi_source_users(adapt.messages(spark, sf_dir), source="k", over=40)


@query(
    "sources_by_sketch",
    s.with_ctes(
        "messages",
        '''SELECT "user", count(*) AS events, count(DISTINCT k) AS sources FROM messages
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1 HAVING count(DISTINCT k) > 0''',
    ),
)
def sources_by_sketch(spark, sf_dir):
    daily = sketches.daily_sketches(adapt.messages(spark, sf_dir), ["user"], "k")
    return sketches.distinct_between(daily, ["user"], "sources", "2024-01-03", "2024-01-20")


@query(
    "sources_of_users",
    s.with_ctes(
        "messages",
        """SELECT DISTINCT "user", k FROM messages WHERE "user" IN
        (SELECT "user" FROM messages GROUP BY 1 HAVING count(DISTINCT k) > 40)""",
    ),
)
def sources_of_users(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    return fanout.sources_of_users(lines, fanout.multi_source_users(lines, source="k", over=40), source="k")


@query(
    "unusual_hours",
    s.with_ctes(
        "log_events",
        """SELECT "user", count(*) AS events, array_to_string(list_sort(list_distinct(list(hour(ts)))), ',') AS hours
        FROM log_events WHERE hour(ts) BETWEEN 1 AND 5 GROUP BY 1""",
    ),
)
def unusual_hours(spark, sf_dir):
    return fanout.unusual_hours(adapt.log_events(spark, sf_dir)).withColumn(
        "hours", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",")
    )


@query(
    "port_scan",
    s.with_ctes(
        "flows",
        """, d AS (SELECT DISTINCT src, dst, dst_port FROM flows WHERE src <> 0 AND dst <> 0 AND dst_port <> 0)
        SELECT src, dst, count(*) AS ports, array_to_string(list_slice(list_sort(list(dst_port)), 1, 3), ',') AS sample_ports
        FROM d GROUP BY 1, 2 HAVING count(*) > 3""",
    ),
)
def port_scan(spark, sf_dir):
    found = fanout.port_scan(adapt.flows(spark, sf_dir), over=3, sample=3)
    return found.withColumn("sample_ports", F.array_join(F.transform("sample_ports", lambda p: p.cast("string")), ","))


@query(
    "distributed_scan",
    s.with_ctes(
        "flows",
        """SELECT src, count(DISTINCT dst) AS targets, count(DISTINCT dst_port) AS ports FROM flows
        WHERE src <> 0 AND dst <> 0 AND dst_port <> 0 GROUP BY 1
        HAVING count(DISTINCT dst) > 9 AND count(DISTINCT dst_port) > 30""",
    ),
)
def distributed_scan(spark, sf_dir):
    return fanout.distributed_scan(adapt.flows(spark, sf_dir), targets=9, ports=30)


PROTOCOL_SQL = """CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' ELSE 'ssh' END"""


def with_protocol(flows):
    slot = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    return flows.withColumn(
        "protocol", F.when(slot == 0, "tcp").when(slot == 1, "http").when(slot == 2, "dns").otherwise("ssh")
    )


@query(
    "protocol_mismatch",
    s.with_ctes(
        "flows",
        f""", p AS (SELECT *, {PROTOCOL_SQL} AS protocol FROM flows)
        SELECT flow_id, dst_port, protocol, expected AS expected_protocol FROM p JOIN
          {s.values([[k, v] for k, v in fanout.STANDARD_PORTS.items()], 'port', 'expected')} e ON dst_port = port
        WHERE upper(protocol) <> upper(expected) AND upper(protocol) <> 'TCP'""",
    ),
)
def protocol_mismatch(spark, sf_dir):
    found = fanout.protocol_mismatch(with_protocol(adapt.flows(spark, sf_dir)))
    return found.select("flow_id", "dst_port", "protocol", "expected_protocol")


@query(
    "multi_geo",
    s.with_ctes(
        "geo_events",
        """SELECT "user", count(DISTINCT country) AS countries, count(*) AS events FROM geo_events WHERE "user" <> 0
        GROUP BY 1 HAVING count(DISTINCT country) > 9""",
    ),
)
def multi_geo(spark, sf_dir):
    return fanout.multi_geo(adapt.geo_events(spark, sf_dir), over=9)


@query(
    "impossible_travel",
    s.with_ctes(
        "geo_events",
        """, o AS (SELECT *, lag(country) OVER w AS prev_country, (us - lag(us) OVER w) / 1e6 AS gap FROM geo_events WHERE "user" <> 0
          WINDOW w AS (PARTITION BY "user" ORDER BY us, l_orderkey, l_linenumber, country))
        SELECT "user", us // 1000000 AS at_s, prev_country, country, gap AS gap_seconds FROM o
        WHERE country <> prev_country AND gap < 7200""",
    ),
)
def impossible_travel(spark, sf_dir):
    found = fanout.impossible_travel(
        adapt.geo_events(spark, sf_dir),
        order_by=["ts", "l_orderkey", "l_linenumber", "country"],
        segment_seconds=90 * 86_400,
    )
    return found.select("user", F.unix_seconds("ts").alias("at_s"), "prev_country", "country", "gap_seconds")


@query(
    "connection_fanout",
    s.with_ctes(
        "flows",
        """SELECT src, count(DISTINCT dst) AS destinations, count(*) AS connections FROM flows WHERE src <> 0 AND dst <> 0
        GROUP BY 1 HAVING count(DISTINCT dst) > 20""",
    ),
)
def connection_fanout(spark, sf_dir):
    return fanout.connection_fanout(adapt.flows(spark, sf_dir), over=20)


@query(
    "out_degree",
    s.with_ctes(
        "flows",
        """SELECT src, count(DISTINCT dst) AS targets, count(*) AS connections, round(least(count(DISTINCT dst) / 10, 0.9), 6) AS confidence
        FROM flows WHERE src <> 0 AND dst <> 0 GROUP BY 1 HAVING count(DISTINCT dst) > 5""",
    ),
)
def out_degree(spark, sf_dir):
    return rounded(fanout.out_degree(adapt.flows(spark, sf_dir)))


@query(
    "rare_patterns",
    s.with_ctes(
        "log_events",
        """, c AS (SELECT 'type:' || event_type || '|src:' || source || '|action:' || action || '|result:' || result AS pattern,
          count(*) AS occurrences, min(event_id) AS first_example FROM log_events GROUP BY 1),
        t AS (SELECT sum(occurrences) AS total FROM c)
        SELECT pattern, occurrences, round(occurrences / total, 6) AS frequency, first_example FROM c, t
        WHERE occurrences <= greatest(1, total * 0.001)""",
    ),
)
def rare_patterns(spark, sf_dir):
    fields = {"type": F.col("event_type"), "src": F.col("source"), "action": F.col("action"), "result": F.col("result")}
    return rounded(fanout.rare_patterns(adapt.log_events(spark, sf_dir), text.log_pattern(fields), "event_id"))


@query(
    "resource_outliers",
    "WITH e AS (SELECT event_id, value FROM events)" + outliers_sql("e", "value")
    + f" SELECT event_id, 'value' AS resource, round(value, 6) AS reading FROM q WHERE {is_outlier('value')} AND value > 60",
)
def resource_outliers(spark, sf_dir):
    events = adapt.table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(fanout.resource_outliers(events, {"value": 60}).drop("value"))


PROC_SQL = """, pr AS (SELECT event_id, CASE k % 6 WHEN 0 THEN 'PowerShell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'rundll32.exe'
     WHEN 3 THEN 'mshta-certutil' ELSE 'app' || k END AS process_name, "user" AS parent_process, k,
     CASE k % 5 WHEN 0 THEN 'C:\\Windows\\System32\\a' WHEN 1 THEN '/home/.ssh/id' WHEN 2 THEN 'C:\\Temp\\x' ELSE '/srv/' || (k % 10) END AS file_path,
     CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'write' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'create' ELSE 'modify' END AS operation,
     CASE k % 4 WHEN 0 THEN 'HKLM\\Software\\Run' WHEN 1 THEN 'HKLM\\Services\\x' ELSE 'HKCU\\Other' END AS registry_key
     FROM log_events)""".replace("\\\\", "\\")


def host_events(spark, sf_dir):
    k, kind = F.col("k"), F.col("event_type")
    ks = k.cast("string")
    return adapt.log_events(spark, sf_dir).select(
        "event_id",
        F.when(k % 6 == 0, "PowerShell.exe").when(k % 6 == 1, "cmd.exe").when(k % 6 == 2, "rundll32.exe")
        .when(k % 6 == 3, "mshta-certutil").otherwise(F.concat(F.lit("app"), ks)).alias("process_name"),
        F.col("user").alias("parent_process"),
        F.when(k % 5 == 0, "C:\\Windows\\System32\\a").when(k % 5 == 1, "/home/.ssh/id").when(k % 5 == 2, "C:\\Temp\\x")
        .otherwise(F.concat(F.lit("/srv/"), (k % 10).cast("string"))).alias("file_path"),
        F.when(kind == "error", "delete").when(kind == "click", "write").when(kind == "view", "read")
        .when(kind == "signup", "create").otherwise("modify").alias("operation"),
        F.when(k % 4 == 0, "HKLM\\Software\\Run").when(k % 4 == 1, "HKLM\\Services\\x").otherwise("HKCU\\Other")
        .alias("registry_key"),
    )


def _word_join(column, words):
    return f"JOIN {s.values([[w] for w in words], 'word')} w ON contains(lower({column}), word)"


@query(
    "suspicious_process",
    s.with_ctes("log_events", PROC_SQL + f" SELECT event_id, process_name, word AS matched_name FROM pr {_word_join('process_name', fanout.LIVING_OFF_THE_LAND)}"),
)
def suspicious_process(spark, sf_dir):
    return fanout.suspicious_process(host_events(spark, sf_dir)).select("event_id", "process_name", "matched_name")


@query(
    "process_parents",
    s.with_ctes(
        "log_events",
        PROC_SQL + """ SELECT lower(process_name) AS process, count(DISTINCT parent_process) AS parent_count, count(*) AS starts
        FROM pr GROUP BY 1 HAVING count(DISTINCT parent_process) > 5""",
    ),
)
def process_parents(spark, sf_dir):
    return fanout.process_parents(host_events(spark, sf_dir))


@query(
    "suspicious_file_op",
    s.with_ctes(
        "log_events",
        PROC_SQL + f""" SELECT event_id, file_path, operation, word AS matched_word FROM pr
        {_word_join('file_path', fanout.SENSITIVE_PATHS)} WHERE operation IN ('write', 'delete', 'modify')""",
    ),
)
def suspicious_file_op(spark, sf_dir):
    return fanout.suspicious_file_op(host_events(spark, sf_dir)).select("event_id", "file_path", "operation", "matched_word")


@query(
    "registry_modification",
    s.with_ctes(
        "log_events",
        PROC_SQL + f""" SELECT event_id, registry_key, operation, word AS matched_word FROM pr
        {_word_join('registry_key', fanout.SENSITIVE_KEYS)} WHERE operation IN ('create', 'modify', 'delete')""",
    ),
)
def registry_modification(spark, sf_dir):
    found = fanout.registry_modification(host_events(spark, sf_dir))
    return found.select("event_id", "registry_key", "operation", "matched_word")


@query(
    "mass_file_op",
    s.with_ctes(
        "log_events",
        PROC_SQL + """, c AS (SELECT lower(file_path) AS path, operation, count(*) AS n FROM pr GROUP BY 1, 2)
        SELECT path, CAST(sum(n) AS BIGINT) AS operation_count, string_agg(operation || '=' || n, ',' ORDER BY operation) AS operations
        FROM c GROUP BY 1 HAVING sum(n) > 100""",
    ),
)
def mass_file_op(spark, sf_dir):
    found = fanout.mass_file_op(host_events(spark, sf_dir))
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("operations")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return found.withColumn("operations", shown)

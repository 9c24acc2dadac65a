"""Correlation of events and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions.predicates import EventFields
from logsieve.operators import correlate, graph
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

DAY = 86400.0


@query(
    "brute_force",
    s.with_ctes(
        "log_events",
        """SELECT g.source, g.event_id, count(*) AS failed_attempts FROM log_events g JOIN log_events b
          ON b.source = g.source AND b.event_type = 'error' AND b.us BETWEEN g.us - 86400000000 AND g.us
        WHERE g.event_type <> 'error' GROUP BY 1, 2 HAVING count(*) >= 3""",
    ),
)
def brute_force(spark, sf_dir):
    bad = F.col("event_type") == "error"
    found = correlate.brute_force(
        adapt.log_events(spark, sf_dir), bad, ~bad, "event_id", ["source"], failures=3, within_seconds=DAY
    )
    return found.select("source", "event_id", F.col("failed_attempts").cast("long").alias("failed_attempts"))


@query("brute_force_slices")
def brute_force_slices(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return correlate.brute_force_slices(
        adapt.log_events(spark, sf_dir).withColumn("target", F.col("source")), bad, ~bad, ["ts", "event_id"], failures=3,
        within_seconds=14 * DAY,
    ).select("target", "event_id", "failed_attempts", "slice_seconds")


@query(
    "lateral_movement",
    s.with_ctes(
        "messages",
        """SELECT a.source, a.entry_id, count(DISTINCT b."user") AS targets, count(*) AS accesses, count(*) FILTER (b.level = 'error') AS privileged
        FROM messages a JOIN messages b ON a.source = b.source AND b.us BETWEEN a.us AND a.us + 14400000000
        GROUP BY 1, 2 HAVING count(DISTINCT b."user") >= 4 AND count(*) FILTER (b.level = 'error') > 0""",
    ),
)
def lateral_movement(spark, sf_dir):
    found = correlate.lateral_movement(
        adapt.messages(spark, sf_dir), F.lit(True), F.col("level") == "error", "entry_id", target="user", targets=4,
        within_seconds=14400,
    )
    return found.select(
        "source", "entry_id", F.col("distinct_user").cast("long").alias("targets"), F.col("accesses").cast("long").alias("accesses"),
        F.col("privileged").cast("long").alias("privileged"),
    )


@query(
    "followed_by",
    s.with_ctes(
        "log_events",
        """SELECT a.source, a.event_id, count(*) FILTER (b.event_type = 'purchase') AS purchases, count(*) FILTER (b.event_type = 'error') AS errors
        FROM log_events a JOIN log_events b ON a.source = b.source AND b.us > a.us AND b.us <= a.us + 43200000000
        WHERE a.event_type = 'signup' GROUP BY 1, 2
        HAVING count(*) FILTER (b.event_type = 'purchase') >= 1 AND count(*) FILTER (b.event_type = 'error') >= 1""",
    ),
)
def followed_by(spark, sf_dir):
    kind = F.col("event_type")
    found = correlate.followed_by(
        adapt.log_events(spark, sf_dir), kind == "signup", {"purchases": kind == "purchase", "errors": kind == "error"},
        "event_id", within_seconds=43200,
    )
    return found.select("source", "event_id", F.col("purchases").cast("long").alias("purchases"), F.col("errors").cast("long").alias("errors"))


RICH_SQL = """, rich AS (SELECT *, CASE event_type WHEN 'signup' THEN 'service' WHEN 'view' THEN 'process' WHEN 'click' THEN 'registry'
      WHEN 'purchase' THEN 'config' ELSE 'login' END AS kind FROM log_events)"""


def rich(spark, sf_dir):
    kind = F.col("event_type")
    base = adapt.log_events(spark, sf_dir)
    return base.select(
        "event_id", "ts", "source", "user", "k",
        F.when(kind == "signup", "service").when(kind == "view", "process").when(kind == "click", "registry")
        .when(kind == "purchase", "config").otherwise("login").alias("event_type"),
        F.when(F.col("k") % 2 == 0, "true").otherwise("false").alias("elevated"),
        F.when(F.col("k") % 3 == 0, "/data/secret.txt").otherwise("/tmp/x").alias("file"),
        (F.col("k") * 2_000_000).alias("bytes"),
        F.when(F.col("k") % 5 == 0, "10.1.1.1").otherwise("93.184.216.34").alias("destination"),
        F.when(F.col("k") > 50, "access").otherwise("none").alias("action"),
        F.when(F.col("k") > 30, "true").otherwise("false").alias("unusual"),
    )


def _after(hours):
    return f"b.us > a.us AND b.us <= a.us + {int(hours * 3600)}000000"


@query(
    "data_exfiltration",
    s.with_ctes(
        "log_events",
        RICH_SQL + f""" SELECT a.source, a.event_id, count(*) AS transfers, CAST(sum(b.k * 2000000) AS DOUBLE) AS bytes_transferred FROM rich a JOIN rich b
        ON a.source = b.source AND {_after(6)} AND b.k * 2000000 > 100000000 AND b.k % 5 <> 0 WHERE a.k % 3 = 0 GROUP BY 1, 2""",
    ),
)
def data_exfiltration(spark, sf_dir):
    df = rich(spark, sf_dir)
    found = correlate.data_exfiltration(df, EventFields(df), "event_id", within_seconds=6 * 3600)
    return rounded(found.select("source", "event_id", F.col("transfers").cast("long").alias("transfers"), "bytes_transferred"))


@query(
    "privilege_escalation",
    s.with_ctes(
        "log_events",
        RICH_SQL + f""" SELECT a.source, a.event_id, count(*) FILTER (b.kind = 'process' AND b.k % 2 = 0) AS elevated_processes,
          count(*) FILTER (b.kind = 'registry') AS registry_changes FROM rich a JOIN rich b ON a.source = b.source AND {_after(24)} WHERE a.kind = 'service'
        GROUP BY 1, 2 HAVING count(*) FILTER (b.kind = 'process' AND b.k % 2 = 0) > 0 AND count(*) FILTER (b.kind = 'registry') > 0""",
    ),
)
def privilege_escalation(spark, sf_dir):
    df = rich(spark, sf_dir)
    found = correlate.privilege_escalation(df, EventFields(df), "event_id", within_seconds=DAY)
    return found.select(
        "source", "event_id", F.col("elevated_processes").cast("long").alias("elevated_processes"),
        F.col("registry_changes").cast("long").alias("registry_changes"),
    )


@query(
    "account_compromise",
    s.with_ctes(
        "log_events",
        RICH_SQL + f""" SELECT a."user", a.event_id, count(*) FILTER (b.kind = 'config') AS config_changes,
          count(*) FILTER (b.k > 50 AND b.k % 3 = 0) AS sensitive_accesses FROM rich a JOIN rich b ON a."user" = b."user" AND {_after(24)}
        WHERE a.kind = 'login' AND a.k > 30
        GROUP BY 1, 2 HAVING count(*) FILTER (b.kind = 'config') > 0 AND count(*) FILTER (b.k > 50 AND b.k % 3 = 0) > 0""",
    ),
)
def account_compromise(spark, sf_dir):
    df = rich(spark, sf_dir)
    found = correlate.account_compromise(df, EventFields(df), "event_id", within_seconds=DAY)
    return found.select(
        "user", "event_id", F.col("config_changes").cast("long").alias("config_changes"),
        F.col("sensitive_accesses").cast("long").alias("sensitive_accesses"),
    )


NAMED_SQL = """, en AS (SELECT entry_id, event_type, us, unnest(list_distinct([source, "user", 'svc-' || (k % 7)])) AS entity FROM messages)"""


def named(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select(
        "entry_id", "event_type", "ts", "source", "user",
        F.concat(F.lit("svc-"), (F.col("k") % 7).cast("string")).alias("service"),
    )


@query(
    "entity_activity",
    s.with_ctes(
        "messages",
        NAMED_SQL + """ SELECT entity, count(DISTINCT entry_id) AS events, count(DISTINCT event_type) AS types,
        min(us) // 1000000 AS first_s, max(us) // 1000000 AS last_s FROM en GROUP BY 1
        HAVING count(DISTINCT entry_id) >= 50 AND count(DISTINCT event_type) >= 3""",
    ),
)
def entity_activity(spark, sf_dir):
    found = correlate.entity_activity(named(spark, sf_dir), "entry_id", min_events=50)
    return found.select("entity", "events", "types", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"))


@query(
    "entity_first_events",
    s.with_ctes(
        "messages",
        NAMED_SQL + """, r AS (SELECT entity, entry_id, row_number() OVER (PARTITION BY entity ORDER BY us, entry_id) AS position FROM en)
        SELECT * FROM r WHERE position <= 20 AND entity IN (SELECT entity FROM en GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT event_type) >= 3)""",
    ),
)
def entity_first_events(spark, sf_dir):
    df = named(spark, sf_dir)
    found = correlate.entity_activity(df, "entry_id")
    return correlate.first_events(df, found, "entry_id").select("entity", "entry_id", "position")


PAIRS_SQL = NAMED_SQL + """, ge AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM en a JOIN en b
      ON a.entry_id = b.entry_id AND a.entity < b.entity GROUP BY 1, 2)"""


@query("graph_build", s.with_ctes("messages", PAIRS_SQL + " SELECT src, dst, weight FROM ge"))
def graph_build(spark, sf_dir):
    return graph.entity_edges(named(spark, sf_dir))


@query("graph_event_edges", s.with_ctes("messages", NAMED_SQL + " SELECT DISTINCT entry_id AS event, entity FROM en"))
def graph_event_edges(spark, sf_dir):
    return graph.event_edges(named(spark, sf_dir), "entry_id")


@query(
    "graph_pivots",
    s.with_ctes(
        "messages",
        PAIRS_SQL + """, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ge UNION ALL SELECT dst FROM ge) GROUP BY 1),
        ev AS (SELECT entity, count(*) AS events FROM en GROUP BY 1), n AS (SELECT count(DISTINCT entry_id) + count(DISTINCT entity) AS nodes FROM en)
        SELECT entity, events, events + degree AS degree, round((events + degree) / (nodes - 1), 6) AS centrality FROM ev JOIN d ON entity = node, n
        WHERE (events + degree) / (nodes - 1) > 0.05 AND events >= 5 AND events + degree >= 5""",
    ),
)
def graph_pivots(spark, sf_dir):
    return rounded(graph.graph_pivots(named(spark, sf_dir), "entry_id", centrality=0.05))


NODES_SQL = PAIRS_SQL + """, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ge UNION ALL SELECT dst FROM ge) GROUP BY 1)
        SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d"""


@query("graph_nodes", s.with_ctes("messages", NODES_SQL))
def graph_nodes(spark, sf_dir):
    return rounded(graph.graph_nodes(graph.entity_edges(named(spark, sf_dir))))


@query("graph_top_nodes", s.with_ctes("messages", NODES_SQL + " ORDER BY degree DESC, node LIMIT 100"))
def graph_top_nodes(spark, sf_dir):
    return rounded(graph.graph_nodes(graph.entity_edges(named(spark, sf_dir)), limit=100))


@query("graph_edges", s.with_ctes("messages", PAIRS_SQL + " SELECT src, dst, weight FROM ge"))
def graph_edges(spark, sf_dir):
    return graph.graph_edges(graph.entity_edges(named(spark, sf_dir)))


@query(
    "graph_size",
    s.with_ctes(
        "messages",
        PAIRS_SQL + """, n AS (SELECT count(*) AS nodes FROM (SELECT src FROM ge UNION SELECT dst FROM ge))
        SELECT nodes, (SELECT count(*) FROM ge) AS edges, round((SELECT count(*) FROM ge) / (nodes * (nodes - 1)), 6) AS density FROM n""",
    ),
)
def graph_size(spark, sf_dir):
    return rounded(graph.graph_size(graph.entity_edges(named(spark, sf_dir))))


def _paths_sql() -> str:
    """Edges only run to the next layer, so the first three partial paths to a node hold the first three of the whole."""
    steps = "".join(
        f""", p{n} AS (SELECT start, e.dst AS last, list_append(path, e.dst) AS path FROM p{n - 1} JOIN e ON e.src = p{n - 1}.last
      QUALIFY row_number() OVER (PARTITION BY start, e.dst ORDER BY list_append(path, e.dst)) <= 3)"""
        for n in range(1, 6)
    )
    done = " UNION ALL ".join(f"SELECT * FROM p{n} WHERE last NOT IN (SELECT src FROM e)" for n in (3, 4, 5))
    return f"""WITH e AS (SELECT DISTINCT k % 5 * 1000 + event_id % 30 AS src, (k % 5 + 1) * 1000 + (event_id * 7 + k) % 30 AS dst
      FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
    p0 AS (SELECT DISTINCT src AS start, src AS last, [src] AS path FROM e WHERE src NOT IN (SELECT dst FROM e)){steps},
    d AS ({done})
    SELECT start, last AS end, array_to_string(path, '>') AS path, CAST(row_number() OVER (PARTITION BY start, last ORDER BY d.path) AS INTEGER) AS position FROM d
    QUALIFY position <= 3"""


@query("graph_paths", _paths_sql())
def graph_paths(spark, sf_dir):
    """Layered edges out of events: five steps from layer to layer."""
    k, user = F.col("k"), F.col("event_id")
    layer = k % 5
    edges = adapt.log_events(spark, sf_dir).select(
        (layer * 1000 + user % 30).alias("src"), ((layer + 1) * 1000 + (user * 7 + k) % 30).alias("dst")
    )
    return graph.graph_paths(edges).withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


TACTIC_TEXT = "lower(message || ' ' || event_type || ' ' || level)"


@query(
    "infer_tactics",
    s.with_ctes(
        "messages",
        " UNION ALL ".join(
            f"SELECT entry_id, '{t}' AS tactic FROM messages WHERE {s.has_any(TACTIC_TEXT, words)}" for t, words in correlate.TACTIC_WORDS.items()
        ),
    ),
)
def infer_tactics(spark, sf_dir):
    from logsieve.functions.rows import explode_computed

    lines = adapt.messages(spark, sf_dir)
    whole = F.concat_ws(" ", "message", "event_type", "level")
    return explode_computed(lines, ["entry_id"], correlate.infer_tactics(whole), "tactic")


FOUND_SQL = """, fd AS (SELECT entry_id AS finding_id, CASE k % 3 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'beaconing' ELSE 'port_scan' END AS type,
      CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, (k % 10) / 10 AS confidence,
      CASE k % 5 WHEN 0 THEN ['initial_access'] WHEN 1 THEN ['execution', 'discovery'] WHEN 2 THEN ['collection', 'exfiltration'] ELSE [] END AS tactics,
      us, source, "user" FROM messages WHERE level = 'error')"""


def findings(spark, sf_dir):
    k = F.col("k")
    return adapt.messages(spark, sf_dir).where("level = 'error'").select(
        F.col("entry_id").alias("finding_id"),
        F.when(k % 3 == 0, "brute_force").when(k % 3 == 1, "beaconing").otherwise("port_scan").alias("type"),
        F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("critical").alias("severity"),
        (k % 10 / 10).alias("confidence"),
        F.when(k % 5 == 0, F.array(F.lit("initial_access"))).when(k % 5 == 1, F.array(F.lit("execution"), F.lit("discovery")))
        .when(k % 5 == 2, F.array(F.lit("collection"), F.lit("exfiltration"))).otherwise(F.array().cast("array<string>")).alias("tactics"),
        F.array("source", "user").alias("entities"),
        F.col("ts").alias("first_ts"),
        F.col("ts").alias("last_ts"),
    )


@query(
    "attack_chains",
    s.with_ctes(
        "messages",
        FOUND_SQL + f""", e AS (SELECT *, unnest([source, "user"]) AS entity FROM fd),
        sev AS {s.values([[n, i] for i, n in enumerate(correlate.SEVERITIES)], 'severity', 'rk')},
        tac AS {s.values([[n, i] for i, n in enumerate(correlate.TACTIC_ORDER)], 'tactic', 'pos')},
        t AS (SELECT entity, count(*) AS findings, min(confidence) AS confidence, min(rk) AS lo, max(rk) AS hi, (max(us) - min(us)) / 1e6 AS dur
              FROM e JOIN sev USING (severity) GROUP BY 1 HAVING count(*) >= 2),
        x AS (SELECT DISTINCT entity, tactic, pos FROM (SELECT entity, unnest(tactics) AS tactic FROM e) JOIN tac USING (tactic)),
        c AS (SELECT entity, count(*) AS n_tactics, string_agg(tactic, ',' ORDER BY pos) AS tactics FROM x GROUP BY 1 HAVING count(*) >= 3)
        SELECT entity, findings, n_tactics, tactics, round(dur, 6) AS duration_seconds, round(confidence, 6) AS confidence,
          a.severity AS severity, b.severity AS max_severity FROM t JOIN c USING (entity) JOIN sev a ON lo = a.rk JOIN sev b ON hi = b.rk""",
    ),
)
def attack_chains(spark, sf_dir):
    found = correlate.attack_chains(findings(spark, sf_dir)).drop("stages")
    return rounded(found.withColumn("tactics", F.array_join("tactics", ",")))


@query(
    "correlation_summary",
    s.with_ctes(
        "messages",
        FOUND_SQL + """ SELECT 'type' AS facet, type AS value, count(*) AS n FROM fd GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM fd GROUP BY 2
        UNION ALL SELECT 'entities', 'distinct', (SELECT count(*) FROM (SELECT source FROM fd UNION SELECT "user" FROM fd))""",
    ),
)
def correlation_summary(spark, sf_dir):
    return correlate.correlation_summary(findings(spark, sf_dir))


@query("merge_findings")
def merge_findings(spark, sf_dir):
    """Findings per (user, day) and per (user, three days) merge where they share events."""
    lines = adapt.messages(spark, sf_dir).where("level = 'error'")
    day = F.date_format("ts", "yyyy-MM-dd")
    block = F.floor(F.unix_seconds("ts") / 259200).cast("string")
    kinds = {"daily": day, "block": block}
    rows = None
    for kind, bucket in kinds.items():
        one = lines.select(
            F.concat_ws("|", F.lit(kind), "user", bucket).alias("finding_id"), "entry_id", F.lit(kind).alias("type"),
            F.when(F.col("k") > 50, "high").otherwise("medium").alias("severity"), (F.col("k") / 100).alias("confidence"),
        )
        rows = one if rows is None else rows.union(one)
    found = rows.groupBy("finding_id", "type").agg(F.max("severity").alias("severity"), F.max("confidence").alias("confidence"))
    return correlate.merge_findings(found, rows.select("finding_id", "entry_id"))

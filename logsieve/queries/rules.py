"""Detection rules over log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import rules as custom
from logsieve.operators import sigma, signatures
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

SIGMA = [
    sigma.SigmaRule(
        "s1", "Failed login", {"selection": {"message|contains": ["failed login", "denied"], "level": "INFO"}, "condition": "selection"},
        "medium", ("attack.credential_access", "attack.t1110"), {"product": "linux", "category": "syslog"},
    ),
    sigma.SigmaRule(
        "s2", "Shell", {
            "selection_a": [{"message|startswith": "powershell"}, {"message|contains": "mimikatz"}],
            "selection_b": {"k": ">40"}, "filter_x": {"source": "host-1*"}, "condition": "all of selection_* and not 1 of filter_*",
        }, "high", ("attack.execution", "attack.t1059"), {"product": "windows"},
    ),
    sigma.SigmaRule(
        "s3", "Web", {"selection": {"message|re": r"union\s+select|\.\./"}, "k_range": {"k": {"min": 10, "max": 80}},
                      "condition": "selection and (k_range or not k_range)"}, "critical", ("attack.t1190",), {"category": "webserver"},
    ),
    sigma.SigmaRule("s4", "All words", {"selection": {"message|contains|all": ["service", "stop"], "k|gte": 50}, "condition": "selection"}, "low"),
    sigma.SigmaRule("s5", "Ends", {"selection": {"message|endswith": "CONNECT", "k|lt": 60}, "other": {"event_type": ["click", "view"]},
                                   "condition": "1 of them"}, "low", ("attack.t1071", "attack.t1041")),
    sigma.SigmaRule("s6", "Never", {"selection": {"no_such_field": "x"}, "condition": "selection"}, "low", ("attack.t1003",)),
]
SIGMA_WHERE = {
    "s1": (0.9, "(contains(lower(message), 'failed login') OR contains(lower(message), 'denied')) AND lower(level) = 'info'"),
    "s2": (0.8, "(starts_with(lower(message), 'powershell') OR contains(lower(message), 'mimikatz')) AND k > 40 AND NOT starts_with(source, 'host-1')"),
    "s3": (0.8, r"regexp_matches(message, '(?i)union\s+select|\.\./')"),
    "s4": (0.9, "contains(lower(message), 'service') AND contains(lower(message), 'stop') AND k >= 50"),
    "s5": (0.8, "(ends_with(lower(message), 'connect') AND k < 60) OR event_type IN ('click', 'view')"),
}
MATCH_SQL = ", sm AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, {c} AS confidence, entry_id, source, level AS lvl FROM messages WHERE {w}" for r, (c, w) in SIGMA_WHERE.items()
) + ")"


@query("sigma_match", s.with_ctes("messages", MATCH_SQL + " SELECT rule_id, confidence, entry_id FROM sm"))
def sigma_match(spark, sf_dir):
    return sigma.sigma_match(adapt.messages(spark, sf_dir), SIGMA)


AGGREGATES = [
    sigma.SigmaRule("a1", "Many failures", {"selection": {"level": "error"}, "condition": "selection | count() by user > 15"}),
    sigma.SigmaRule("a2", "Frame", {"selection": {"level": "error"}, "timeframe": "1h", "condition": "selection | count(by source) > 2"}),
    sigma.SigmaRule("a3", "Sum", {"selection": {"event_type": "click"}, "timeframe": "1d", "condition": "selection | sum(k) by user >= 250"}),
    sigma.SigmaRule("a4", "Distinct", {"selection": {"event_type": "view"}, "condition": "selection | count(k) by source > 75"}),
]


@query(
    "sigma_aggregates",
    s.with_ctes(
        "messages",
        """SELECT 'a1' AS rule_id, 0.85 AS confidence, entry_id FROM messages WHERE level = 'error' AND "user" IN
          (SELECT "user" FROM messages WHERE level = 'error' GROUP BY 1 HAVING count(*) > 15)
        UNION ALL SELECT 'a2', 0.85, entry_id FROM messages WHERE level = 'error' AND (source, us // 3600000000) IN
          (SELECT source, us // 3600000000 FROM messages WHERE level = 'error' GROUP BY 1, 2 HAVING count(*) > 2)
        UNION ALL SELECT 'a3', 0.85, entry_id FROM messages WHERE event_type = 'click' AND ("user", us // 86400000000) IN
          (SELECT "user", us // 86400000000 FROM messages WHERE event_type = 'click' GROUP BY 1, 2 HAVING sum(k) >= 250)
        UNION ALL SELECT 'a4', 0.85, entry_id FROM messages WHERE event_type = 'view' AND source IN
          (SELECT source FROM messages WHERE event_type = 'view' GROUP BY 1 HAVING count(DISTINCT k) > 75)""",
    ),
)
def sigma_aggregates(spark, sf_dir):
    return sigma.sigma_match(adapt.messages(spark, sf_dir), AGGREGATES)


ROUTED_SQL = {"syslog": ("s1",), "windows_event": ("s2",), "apache": ("s3",)}


@query(
    "sigma_log_source_routing",
    s.with_ctes(
        "messages",
        MATCH_SQL + """, r(log_type, rule_id) AS (VALUES ('syslog', 's1'), ('windows_event', 's2'), ('windows_event', 's4'), ('windows_event', 's5'),
          ('apache', 's3'))
        SELECT log_type, sm.rule_id, count(*) AS n FROM sm JOIN r USING (rule_id) WHERE rule_id IN ('s1', 's2', 's3') GROUP BY 1, 2""",
    ),
)
def sigma_log_source_routing(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    routed = None
    for log_type in ("syslog", "windows_event", "apache"):
        own = [r for r in sigma.applicable_rules(SIGMA, log_type) if r.logsource]
        part = sigma.sigma_match(lines, own).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
        part = part.withColumn("log_type", F.lit(log_type))
        routed = part if routed is None else routed.unionByName(part)
    return routed


CATALOGUE_SQL = "," + "r AS " + s.values(
    [[r.id, r.title, r.level, sigma.attack_id(r.tags), str(r.logsource.get("product", "*")), str(r.logsource.get("category", "*"))] for r in SIGMA],
    "rule_id", "title", "level", "attack_id", "product", "category",
)


@query(
    "sigma_consolidated",
    s.with_ctes(
        "messages",
        MATCH_SQL + CATALOGUE_SQL + """ SELECT rule_id, title, r.level, attack_id, count(DISTINCT entry_id) AS match_count, max(confidence) AS confidence
        FROM sm JOIN r USING (rule_id) GROUP BY 1, 2, 3, 4""",
    ),
)
def sigma_consolidated(spark, sf_dir):
    found = sigma.sigma_match(adapt.messages(spark, sf_dir), SIGMA)
    return sigma.consolidate(found, sigma.rules_table(spark, SIGMA)).select(
        "rule_id", "title", "level", "attack_id", "match_count", "confidence"
    )


TECHNIQUE_ROWS = [[r.id, t.replace("attack.", "").upper()] for r in SIGMA for t in r.tags if t.startswith("attack.t")]


@query(
    "rule_coverage",
    s.with_ctes(
        "messages",
        MATCH_SQL + CATALOGUE_SQL + f""", h AS (SELECT r.*, (SELECT count(*) FROM sm WHERE sm.rule_id = r.rule_id) AS hits FROM r),
        f AS (SELECT 'level' AS facet, level AS value, hits FROM h UNION ALL SELECT 'product', product, hits FROM h
          UNION ALL SELECT 'category', category, hits FROM h UNION ALL SELECT 'technique', tech, hits FROM h JOIN
          {s.values(TECHNIQUE_ROWS, 'rid', 'tech')} t ON rid = rule_id)
        SELECT facet, value, count(*) AS rules, count(*) FILTER (hits > 0) AS rules_hit, CAST(sum(hits) AS BIGINT) AS matches FROM f GROUP BY 1, 2""",
    ),
)
def rule_coverage(spark, sf_dir):
    found = sigma.sigma_match(adapt.messages(spark, sf_dir), SIGMA)
    return sigma.rule_coverage(found, sigma.rules_table(spark, SIGMA))


def leaf(field, operator, value=None, **more):
    return {"field": field, "operator": operator, "value": value, **more}


# one rule per operator, over columns of `lines`
OPERATOR_TESTS = {
    "equals": (leaf("event_type", "equals", "CLICK"), "event_type = 'click'"),
    "equals_case": (leaf("event_type", "equals", "CLICK", case_sensitive=True), "false"),
    "not_equals": (leaf("event_type", "not_equals", "click"), "event_type <> 'click'"),
    "greater_than": (leaf("k", "greater_than", 50), "k > 50"),
    "less_than": (leaf("k", "less_than", "20"), "k < 20"),
    "greater_equal": (leaf("k", "greater_equal", 90), "k >= 90"),
    "less_equal": (leaf("message", "less_equal", 90), "false"),
    "contains": (leaf("message", "contains", "LOGIN"), "contains(lower(message), 'login')"),
    "not_contains": (leaf("message", "not_contains", "login"), "NOT contains(lower(message), 'login')"),
    "starts_with": (leaf("message", "starts_with", "get "), "starts_with(lower(message), 'get ')"),
    "ends_with": (leaf("message", "ends_with", "by ROOT"), "ends_with(lower(message), 'by root')"),
    "matches": (leaf("message", "matches", r"user_\d+\s+from"), r"regexp_matches(message, '(?i)user_\d+\s+from')"),
    "in": (leaf("event_type", "in", ["Click", "view"]), "event_type IN ('click', 'view')"),
    "not_in": (leaf("event_type", "not_in", ["click", "view"]), "event_type NOT IN ('click', 'view')"),
    "any_of": (leaf("labels", "any_of", ["ERROR", "zzz"]), "event_type = 'error'"),
    "all_of": (leaf("labels", "all_of", ["error", "host-3"]), "event_type = 'error' AND source = 'host-3'"),
    "exists": (leaf("odd", "exists"), "k % 2 = 1"),
    "not_exists": (leaf("odd", "not_exists"), "k % 2 = 0"),
    "is_null": (leaf("odd", "is_null"), "k % 2 = 0"),
    "is_not_null": (leaf("odd", "is_not_null"), "k % 2 = 1"),
    "in_cidr": (leaf("ip", "in_cidr", "10.0.0.0/9"), "k < 128"),
    "is_private_ip": (leaf("ip", "is_private_ip"), "true"),
    "is_public_ip": (leaf("ip", "is_public_ip"), "false"),
    "within_last": (leaf("ts", "within_last", "2d"), "ts >= TIMESTAMP '2024-01-18 12:00:00'"),
    "older_than": (leaf("ts", "older_than", "240h"), "ts < TIMESTAMP '2024-01-10 12:00:00'"),
    "between_times": (leaf("ts", "between_times", ["08:00", "09:30"]), "strftime(ts, '%H:%M') BETWEEN '08:00' AND '09:30'"),
    "negate": (leaf("k", "greater_than", 50, negate=True), "NOT k > 50"),
    "tree": (
        {"operator": "and", "conditions": [
            leaf("k", "greater_than", 20),
            {"operator": "or", "conditions": [leaf("event_type", "equals", "view"), {"operator": "not", "conditions": [leaf("message", "contains", "user")]}]},
        ]},
        "k > 20 AND (event_type = 'view' OR NOT contains(lower(message), 'user'))",
    ),
    "dotted_path": (leaf("nested.kind", "equals", "signup"), "event_type = 'signup'"),
    "event_count": (leaf("event_count", "equals", 1), "true"),
}
CUSTOM = [custom.CustomRule(name, f"rule {name}", node, severity="high") for name, (node, _) in OPERATOR_TESTS.items()]
NOW = "2024-01-20 12:00:00"


def lines(spark, sf_dir):
    return adapt.messages(spark, sf_dir).select(
        "entry_id", "message", "event_type", "source", "user", "k", "ts", "level",
        F.array("event_type", "source").alias("labels"),
        F.when(F.col("k") % 2 == 1, F.col("k").cast("string")).alias("odd"),
        F.concat(F.lit("10."), F.col("k").cast("string"), F.lit(".0.1")).alias("ip"),
        F.struct(F.col("event_type").alias("kind")).alias("nested"),
    )


CUSTOM_SQL = ", cm AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS rule_id, entry_id FROM messages WHERE {w}" for n, (_, w) in OPERATOR_TESTS.items()
) + ")"


@query("custom_match", s.with_ctes("messages", CUSTOM_SQL + " SELECT rule_id, count(*) AS n, count(DISTINCT entry_id) AS entries, sum(CAST(entry_id AS BIGINT))::BIGINT AS checksum FROM cm GROUP BY 1"))
def custom_match(spark, sf_dir):
    found = custom.custom_match(lines(spark, sf_dir), CUSTOM, F.lit(NOW).cast("timestamp"))
    return found.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entry_id").alias("entries"), F.sum(F.col("entry_id").cast("long")).alias("checksum")
    )


@query(
    "custom_summary",
    s.with_ctes(
        "messages",
        CUSTOM_SQL + f""" SELECT (SELECT count(*) FROM messages) AS events, count(*) AS matches, count(DISTINCT entry_id) AS events_matched,
        count(DISTINCT rule_id) AS rules_hit, {len(CUSTOM)} AS rules_evaluated FROM cm""",
    ),
)
def custom_summary(spark, sf_dir):
    df = lines(spark, sf_dir)
    return custom.evaluation_summary(df, CUSTOM, custom.custom_match(df, CUSTOM, F.lit(NOW).cast("timestamp")), "entry_id")


ACTION_RULE = custom.CustomRule(
    "r1", "Logins", leaf("message", "contains", "login"), severity="high", tags=("auth", "watch"), description="a login",
    metadata={"team": "soc"},
)


def login_matches(spark, sf_dir):
    return custom.custom_match(lines(spark, sf_dir), [ACTION_RULE])


LOGINS = "contains(lower(message), 'login')"


@query(
    "custom_alerts",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, 'r1' AS rule_id, 'critical' AS severity, 'Login of ' || "user" || ' on {{nope}}' AS title,
        'seen: ' || event_type AS description, 'auth,watch' AS tags, 'soc' AS team, 'x' AS prio FROM messages WHERE {LOGINS}""",
    ),
)
def custom_alerts(spark, sf_dir):
    action = {
        "action": "alert", "severity": "critical", "title_template": "Login of {user} on {nope}",
        "description_template": "seen: {event_type}", "metadata": {"prio": "x"},
    }
    found = custom.run_action(login_matches(spark, sf_dir), ACTION_RULE, action, ["entry_id"])
    return found.select(
        "entry_id", "rule_id", "severity", "title", "description", F.array_join("tags", ",").alias("tags"),
        F.col("metadata")["team"].alias("team"), F.col("metadata")["prio"].alias("prio"),
    )


@query(
    "custom_tags",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, unnest(['auth', 'watch', 'fixed', 'kind-' || event_type]) AS tag FROM messages WHERE {LOGINS}""",
    ),
)
def custom_tags(spark, sf_dir):
    action = {"action": "tag", "tags": ["fixed", "auth"], "tag_template": "kind-{event_type}"}
    return custom.run_action(login_matches(spark, sf_dir), ACTION_RULE, action, ["entry_id"])


@query(
    "custom_extracts",
    s.with_ctes(
        "messages",
        rf"""SELECT entry_id, "user" AS who, coalesce(nullif(regexp_extract(message, 'from (\S+)', 1), ''), 'none') AS origin,
        coalesce(nullif(regexp_extract(message, 'port \d+', 0), ''), 'none') AS port FROM messages WHERE {LOGINS}""",
    ),
)
def custom_extracts(spark, sf_dir):
    action = {
        "action": "extract", "fields": {"who": "user"},
        "regex_extracts": {"origin": {"pattern": r"from (\S+)"}, "port": {"pattern": r"port \d+", "field": "message"}},
    }
    found = custom.run_action(login_matches(spark, sf_dir), ACTION_RULE, action, ["entry_id"])
    return found.select("entry_id", "who", F.coalesce("origin", F.lit("none")).alias("origin"), F.coalesce("port", F.lit("none")).alias("port"))


@query(
    "custom_enrichment",
    s.with_ctes(
        "messages",
        f"""SELECT entry_id, 'dmz' AS zone, "user" || '@' || source AS account, CASE event_type WHEN 'click' THEN 'ui' WHEN 'error' THEN 'fault' ELSE 'other' END AS class,
        upper(source) AS host_upper, 'r1' AS rule_id FROM messages WHERE {LOGINS}""",
    ),
)
def custom_enrichment(spark, sf_dir):
    action = {
        "action": "enrich", "fields": {"zone": "dmz"},
        "computed_fields": {
            "account": "{user}@{source}",
            "class": {"type": "lookup", "field": "event_type", "table": {"click": "ui", "error": "fault"}, "default": "other"},
            "host_upper": {"type": "transform", "field": "source", "transform": "upper"},
        },
    }
    found = custom.run_action(login_matches(spark, sf_dir), ACTION_RULE, action, ["entry_id"])
    return found.select("entry_id", "zone", "account", "class", "host_upper", "rule_id")


@query(
    "custom_table_lookup",
    """SELECT c_custkey, coalesce(n_name, 'nowhere') AS place FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""",
)
def custom_table_lookup(spark, sf_dir):
    nation = adapt.table(spark, sf_dir, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    found = custom.enriched_from_table(adapt.table(spark, sf_dir, "customer"), nation, "c_nationkey", "n_name", "place", "nowhere")
    return found.select("c_custkey", "place")


@query(
    "custom_aggregates",
    s.with_ctes(
        "messages",
        f"""SELECT 'count' AS aggregation, event_type AS group_value, CAST(count(*) AS DOUBLE) AS value FROM messages WHERE {LOGINS} GROUP BY 2
        UNION ALL SELECT 'sum', 'all', CAST(sum(k) AS DOUBLE) FROM messages WHERE {LOGINS}
        UNION ALL SELECT 'unique', source, count(DISTINCT "user") FROM messages WHERE {LOGINS} GROUP BY 2""",
    ),
)
def custom_aggregates(spark, sf_dir):
    found = login_matches(spark, sf_dir)
    actions = [
        {"action": "aggregate", "type": "count", "group_by": "event_type"},
        {"action": "aggregate", "type": "sum", "field": "k"},
        {"action": "aggregate", "type": "unique", "field": "user", "group_by": "source"},
    ]
    parts = [custom.run_action(found, ACTION_RULE, a, ["entry_id"]).drop("rule_id") for a in actions]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


P = signatures.Pattern
SIGNATURES = [
    signatures.SignatureRule("Credential_Dumping", {"m1": P("mimikatz", True), "m2": P("LSASS", True), "m3": P("hashdump")},
                             "any of ($m*)", "high", "credential", "T1003", ("APT",)),
    signatures.SignatureRule("Web_Attack", {"a1": P("union select", True), "a2": P("/etc/passwd"), "b": P(r"port: \d+", regex=True)},
                             "$a1 or ($a2 and $b)", "medium", "web", "T1190"),
    signatures.SignatureRule("Two_Words", {"w1": P("SERVICE", True), "w2": P("shutdown"), "w3": P("root"), "w4": P("stop")},
                             "3 of ($w*) and not $w2", "low", "ops", "", ("experimental",)),
    signatures.SignatureRule("All_Words", {"w1": P("service"), "w2": P("shutdown"), "w3": P("root"), "w4": P("stop"), "w5": P("unit"), "w6": P("of")},
                             "all of them", "low", "ops"),
]
SIGNATURE_SQL = """, sg AS (
    SELECT entry_id, 'Credential_Dumping' AS rule, 'critical' AS severity, 'credential' AS category, 'T1003' AS mitre_technique, 0.9 AS confidence,
      concat_ws(',', CASE WHEN contains(lower(message), 'mimikatz') THEN 'mimikatz' END, CASE WHEN contains(lower(message), 'lsass') THEN 'LSASS' END,
      CASE WHEN contains(message, 'hashdump') THEN 'hashdump' END) AS strings FROM messages
      WHERE contains(lower(message), 'mimikatz') OR contains(lower(message), 'lsass') OR contains(message, 'hashdump')
    UNION ALL SELECT entry_id, 'Web_Attack', 'medium', 'web', 'T1190', 0.8,
      concat_ws(',', CASE WHEN contains(lower(message), 'union select') THEN 'union select' END, CASE WHEN contains(message, '/etc/passwd') THEN '/etc/passwd' END,
      CASE WHEN regexp_matches(message, 'port: \\d+') THEN 'port: \\d+' END) FROM messages
      WHERE contains(lower(message), 'union select') OR (contains(message, '/etc/passwd') AND regexp_matches(message, 'port: \\d+'))
    UNION ALL SELECT entry_id, 'All_Words', 'low', 'ops', '', 0.9, 'service,shutdown,root,stop,unit,of' FROM messages
      WHERE contains(message, 'service') AND contains(message, 'shutdown') AND contains(message, 'root') AND contains(message, 'stop')
        AND contains(message, 'unit') AND contains(message, 'of'))""".replace("\\\\", "\\")


@query("signature_match", s.with_ctes("messages", SIGNATURE_SQL + " SELECT entry_id, rule, severity, category, mitre_technique, round(confidence, 6) AS confidence, strings FROM sg"))
def signature_match(spark, sf_dir):
    found = signatures.signature_match(adapt.messages(spark, sf_dir), SIGNATURES)
    return rounded(found.withColumn("strings", F.array_join("strings", ",")))


RULE_SET = 5000
RULE_CONDITIONS = ("any of them", "$a and not $c", "2 of them", "$c and ($a or not $b)", "all of ($a, $b)")


def _rule_set() -> list[signatures.SignatureRule]:
    return [
        signatures.SignatureRule(
            f"rule_{i}", {"a": P(f"user_{i} FROM", True), "b": P(f"203.0.113.{i % 256};"), "c": P(f"Unit-{i % 128} by", True)}, RULE_CONDITIONS[i % 5], "low", "ops", "T1000",
            ("APT",) if i % 7 == 0 else (),
        )
        for i in range(RULE_SET)
    ]


@query(
    "signature_rule_set",
    s.with_ctes(
        "messages",
        f""", rs AS (SELECT unnest(range({RULE_SET})) AS i),
    st AS (SELECT i, 0 AS place, 'user_' || i || ' FROM' AS shown, 'user_' || i || ' from' AS needle, true AS nocase FROM rs
      UNION ALL SELECT i, 1, '203.0.113.' || (i % 256) || ';', '203.0.113.' || (i % 256) || ';', false FROM rs
      UNION ALL SELECT i, 2, 'Unit-' || (i % 128) || ' by', 'unit-' || (i % 128) || ' by', true FROM rs),
    nd AS (SELECT DISTINCT needle, nocase FROM st),
    ht AS (SELECT entry_id, needle, nocase FROM messages, nd WHERE contains(CASE WHEN nocase THEN lower(message) ELSE message END, needle)),
    pr AS (SELECT entry_id, i, bool_or(place = 0) AS a, bool_or(place = 1) AS b, bool_or(place = 2) AS c, count(*) AS n, string_agg(shown, ',' ORDER BY place) AS strings
      FROM ht JOIN st USING (needle, nocase) GROUP BY 1, 2)
    SELECT entry_id, 'rule_' || i AS rule, 'low' AS severity, 'ops' AS category, 'T1000' AS mitre_technique, CASE WHEN i % 7 = 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, strings
    FROM pr WHERE CASE i % 5 WHEN 0 THEN true WHEN 1 THEN a AND NOT c WHEN 2 THEN n >= 2 WHEN 3 THEN c AND (a OR NOT b) ELSE a AND b END""",
    ),
)
def signature_rule_set(spark, sf_dir):
    found = signatures.signature_match(adapt.messages(spark, sf_dir), _rule_set())
    return rounded(found.withColumn("strings", F.array_join("strings", ",")))

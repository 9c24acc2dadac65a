"""Technique mapping over indicators of the whole corpus and behaviour in log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import text
from logsieve.operators import attack, ioc, sigma, signatures
from logsieve.operators.timing import rounded
from logsieve.queries import rules as rule_queries
from logsieve.queries import sqlkit as s
from logsieve.queries.indicators import KEEP
from logsieve.queries.intel import PUBLIC_SQL, feed
from logsieve.queries.registry import query
from logsieve.queries.scalars import count_chars_sql

PHISHING = "(" + " OR ".join(
    f"(contains(lower(v), {s.text(w)}) AND NOT ends_with(lower(v), {s.text(w + '.com')}))" for w in text.PHISHING_WORDS
) + ")"
KINDS = {k: ioc.BASIC_PATTERNS[k] for k in ioc.MAPPED_KINDS}
IOC_SQL = (
    f", {s.CORPUS_TEXTS}, raw AS (" + s.find_all("c", KINDS, KEEP, guarded="g")
    + """), iv AS (SELECT DISTINCT kind AS ioc_type, ioc_value AS v FROM raw WHERE NOT (kind = 'domains' AND regexp_matches(ioc_value, '\\.(log|txt|json|xml)$'))),
    im AS (SELECT 'T1568.002' AS technique, 0.9 AS confidence, 'DGA domain: ' || v AS evidence FROM iv WHERE ioc_type = 'domains' AND length(v) > 15 AND """.replace("\\\\", "\\")
    + f"{count_chars_sql('lower(v)', text.CONSONANTS)} / length(v) > 0.75"
    + f""" UNION ALL SELECT 'T1566', 0.9, 'Phishing domain: ' || v FROM iv WHERE ioc_type = 'domains' AND {PHISHING}
    UNION ALL SELECT 'T1105', 0.7, 'Download URL: ' || v FROM iv WHERE ioc_type = 'urls' AND {s.has_any('lower(v)', ('download', 'update'))}
    UNION ALL SELECT 'T1059', 0.8, 'Script URL: ' || v FROM iv WHERE ioc_type = 'urls' AND {s.has_any('lower(v)', ('.ps1', '.vbs', '.js', '.bat'))}
    UNION ALL SELECT 'T1204', 0.5, 'File hash: ' || v FROM iv WHERE ioc_type = 'hashes'
    UNION ALL SELECT 'T1090.003', 0.8, 'Tor exit node: ' || v FROM iv WHERE ioc_type = 'ips' AND v IN (SELECT ioc_value FROM feed WHERE threat_type = 'tor_exit'))"""
)


def ioc_mapping(spark, sf_dir):
    found = ioc.extract_iocs(adapt.corpus(spark, sf_dir), kinds=ioc.MAPPED_KINDS)
    return attack.map_iocs(found, feed(spark, sf_dir))


@query("map_iocs", s.with_ctes("messages corpus", PUBLIC_SQL + IOC_SQL + " SELECT technique, round(confidence, 6) AS confidence, evidence FROM im"))
def map_iocs(spark, sf_dir):
    return rounded(ioc_mapping(spark, sf_dir))


BEHAVIOUR_ROWS = [[b, t, c] for b, pairs in attack.BEHAVIOUR_TECHNIQUES.items() for t, c in pairs]
BEHAVIOUR_SQL = (
    ", bh AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS behaviour, count(*) AS n FROM messages WHERE regexp_matches(lower(message), {s.text(p)})" for n, p in attack.BEHAVIOUR_TESTS.items()
    ) + f"), bt AS {s.values(BEHAVIOUR_ROWS, 'behaviour', 'technique', 'base')}, bm AS (SELECT technique, least(base + n * 0.05, 1.0) AS confidence,"
    " behaviour || ' detected ' || n || ' times' AS evidence FROM bh JOIN bt USING (behaviour) WHERE n > 0)"
)


@query("map_behaviours", s.with_ctes("messages", BEHAVIOUR_SQL + " SELECT technique, round(confidence, 6) AS confidence, evidence FROM bm"))
def map_behaviours(spark, sf_dir):
    return rounded(attack.map_behaviours(adapt.messages(spark, sf_dir)))


SIGNATURE_MAP_SQL = rule_queries.SIGNATURE_SQL + """, gm AS (SELECT CASE WHEN mitre_technique <> '' THEN mitre_technique END AS technique, max(confidence) AS confidence,
    'Signature: ' || rule AS evidence FROM sg GROUP BY rule, mitre_technique HAVING mitre_technique <> '')"""


@query("map_signatures", s.with_ctes("messages", SIGNATURE_MAP_SQL + " SELECT technique, round(confidence, 6) AS confidence, evidence FROM gm"))
def map_signatures(spark, sf_dir):
    found = signatures.signature_match(adapt.messages(spark, sf_dir), rule_queries.SIGNATURES)
    return rounded(attack.map_signatures(found))


TAG_ROWS = [[r.id, r.title, t.replace("attack.", "").upper()] for r in rule_queries.SIGMA for t in r.tags if t.startswith("attack.t")]
SIGMA_MAP_SQL = rule_queries.MATCH_SQL + f""", tg AS {s.values(TAG_ROWS, 'rule_id', 'title', 'technique')},
    zm AS (SELECT technique, max(confidence) AS confidence, 'Rule: ' || title AS evidence FROM sm JOIN tg USING (rule_id) GROUP BY 1, 3)"""


@query("map_sigma", s.with_ctes("messages", SIGMA_MAP_SQL + " SELECT technique, round(confidence, 6) AS confidence, evidence FROM zm"))
def map_sigma(spark, sf_dir):
    return rounded(attack.map_sigma(sigma_rows(spark, sf_dir)))


def sigma_rows(spark, sf_dir):
    found = sigma.sigma_match(adapt.messages(spark, sf_dir), rule_queries.SIGMA)
    return sigma.consolidate(found, sigma.rules_table(spark, rule_queries.SIGMA))


TOOL_ROWS = [[k, t, c] for k, pairs in attack.TOOL_TECHNIQUES.items() for t, c in pairs]


@query(
    "map_tools",
    s.with_ctes(
        "messages",
        f""", tt AS {s.values(TOOL_ROWS, 'tool', 'technique', 'base')} SELECT DISTINCT technique, base AS confidence, 'Tool: ' || tool AS evidence
        FROM tt JOIN messages ON contains(lower(message), tool)""",
    ),
)
def map_tools(spark, sf_dir):
    return attack.map_tools(adapt.messages(spark, sf_dir))


TECHNIQUE_ROWS = [[t, n, "|".join(ta)] for t, (n, ta, _) in attack.TECHNIQUES.items()]
SUB_ROWS = [[t, x] for t, (_, _, subs) in attack.TECHNIQUES.items() for x in subs]
ALL_SQL = (
    PUBLIC_SQL + IOC_SQL + BEHAVIOUR_SQL + SIGNATURE_MAP_SQL + SIGMA_MAP_SQL
    + f""", alls AS (SELECT * FROM im UNION ALL SELECT * FROM bm UNION ALL SELECT * FROM gm UNION ALL SELECT * FROM zm),
    sc AS (SELECT technique, max(confidence) AS confidence, count(DISTINCT evidence) AS evidence_count, min(evidence) AS first_evidence FROM alls GROUP BY 1),
    cat AS {s.values(TECHNIQUE_ROWS, 'technique', 'name', 'tactics')}, subs AS {s.values(SUB_ROWS, 'technique', 'sub_technique')},
    tq AS (SELECT technique, name, tactics, round(confidence, 2) AS confidence, evidence_count, first_evidence,
       (SELECT string_agg(sub_technique, ',' ORDER BY sub_technique) FROM subs JOIN sc z ON z.technique = sub_technique WHERE subs.technique = cat.technique) AS sub_techniques
       FROM sc JOIN cat USING (technique) WHERE confidence >= 0.6)"""
)


def scored(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    found = signatures.signature_match(lines, rule_queries.SIGNATURES)
    return attack.technique_scores(
        ioc_mapping(spark, sf_dir), attack.map_behaviours(lines), attack.map_signatures(found), attack.map_sigma(sigma_rows(spark, sf_dir))
    )


@query(
    "technique_scores",
    s.with_ctes("messages corpus", ALL_SQL + " SELECT technique, name, tactics, confidence, evidence_count, first_evidence, coalesce(sub_techniques, '') AS sub_techniques FROM tq"),
)
def technique_scores(spark, sf_dir):
    subs = F.array_join(F.transform("sub_techniques", lambda x: x["sub_technique"]), ",")
    return scored(spark, sf_dir).withColumns({"tactics": F.array_join("tactics", "|"), "sub_techniques": F.coalesce(subs, F.lit(""))})


TACTICS_SQL = ALL_SQL + ", ta AS (SELECT technique, name, confidence, first_evidence, unnest(string_split(tactics, '|')) AS tactic FROM tq)"


@query(
    "tactic_summary",
    s.with_ctes("messages corpus", TACTICS_SQL + " SELECT tactic, count(*) AS technique_count, string_agg(technique, ',' ORDER BY technique) AS techniques FROM ta GROUP BY 1"),
)
def tactic_summary(spark, sf_dir):
    return attack.tactic_summary(scored(spark, sf_dir)).withColumn("techniques", F.array_join("techniques", ","))


ORDER_ROWS = [[t, i] for i, t in enumerate(attack.TACTIC_ORDER)]


@query(
    "tactic_chain",
    s.with_ctes(
        "messages corpus",
        TACTICS_SQL + f""", o AS {s.values(ORDER_ROWS, 'tactic', 'tactic_no')}, b AS (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY confidence DESC, technique) AS rn FROM ta)
        SELECT tactic, tactic_no, technique, name, confidence, first_evidence FROM b JOIN o USING (tactic) WHERE rn = 1""",
    ),
)
def tactic_chain(spark, sf_dir):
    return attack.tactic_chain(scored(spark, sf_dir))


@query(
    "threat_assessment",
    s.with_ctes(
        "messages corpus",
        TACTICS_SQL + f""", n AS (SELECT count(*) AS n, avg(confidence) AS mc, count(*) FILTER (technique IN {attack.CRITICAL_TECHNIQUES}) AS cr,
          count(*) FILTER (technique IN {attack.HIGH_TECHNIQUES}) AS hi, count(*) FILTER (technique IN {attack.IMPACT_TECHNIQUES}) AS im2 FROM tq),
        t AS (SELECT count(DISTINCT tactic) AS t FROM ta)
        SELECT CASE WHEN cr > 0 THEN 'critical' WHEN hi >= 2 THEN 'high' WHEN hi >= 1 OR n >= 3 THEN 'medium' ELSE 'low' END AS severity,
          CASE WHEN t >= 5 THEN 'high' WHEN t >= 3 THEN 'medium' ELSE 'low' END AS sophistication,
          CASE WHEN im2 > 0 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS impact_potential,
          CASE WHEN mc >= 0.85 THEN 'high' WHEN mc >= 0.7 THEN 'medium' ELSE 'low' END AS detection_confidence FROM n, t""",
    ),
)
def threat_assessment(spark, sf_dir):
    return attack.threat_assessment(scored(spark, sf_dir)).drop("advice")


MITIGATION_ROWS = [[t, i, m] for i, (t, ms) in enumerate(attack.MITIGATIONS.items()) for m in ms]


@query(
    "mitigations",
    s.with_ctes(
        "messages corpus",
        ALL_SQL + f""", mt AS {s.values(MITIGATION_ROWS, 'technique', 'no', 'mitigation')}, f AS (SELECT mitigation, arg_min(technique, no) AS technique
          FROM mt WHERE technique IN (SELECT technique FROM tq) GROUP BY 1)
        SELECT mitigation, technique, CASE WHEN technique IN ('T1003', 'T1486') THEN 'high' ELSE 'medium' END AS priority FROM f""",
    ),
)
def mitigations(spark, sf_dir):
    return attack.mitigations(scored(spark, sf_dir))

"""Behaviour patterns over log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import fanout, pattern
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query


def _behaves(name):
    a, b = pattern.BEHAVIOURS[name]
    return f"(regexp_matches(message, {s.text(a)}) OR regexp_matches(message, {s.text(b)}))"


@query(
    "behaviour_tags",
    s.with_ctes(
        "messages",
        " UNION ALL ".join(f"SELECT entry_id, '{n}' AS behaviour FROM messages WHERE {_behaves(n)}" for n in pattern.BEHAVIOURS),
    ),
)
def behaviour_tags(spark, sf_dir):
    return pattern.behaviour_tags(adapt.messages(spark, sf_dir))


WINDOWS = {"defense_evasion": (7 * 86400.0, 3)}


@query(
    "behavioural_indicators",
    s.with_ctes(
        "messages",
        f""", f AS (SELECT file_id, entry_id, us, lower(message) AS m,
            max(CASE WHEN {s.has_any('lower(message)', pattern.CONTEXT_WORDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY us
              ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM messages),
        pe AS (SELECT file_id, entry_id, 'privilege_escalation' AS indicator, 'high' AS severity, 0.7 AS confidence FROM f
            WHERE near = 1 AND {s.has_any('m', pattern.INDICATORS['privilege_escalation']['words'])}),
        de0 AS (SELECT file_id, entry_id, us FROM f WHERE {s.has_any('m', pattern.INDICATORS['defense_evasion']['words'])}),
        de AS (SELECT a.file_id, a.entry_id, 'defense_evasion', 'high', 0.7 FROM de0 a JOIN de0 b
            ON a.file_id = b.file_id AND abs(a.us - b.us) <= 604800000000 GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT * FROM pe UNION ALL SELECT * FROM de""",
    ),
)
def behavioural_indicators(spark, sf_dir):
    found = pattern.behavioural_indicators(adapt.messages(spark, sf_dir), ["ts", "line_no"], windows=WINDOWS)
    return rounded(found)


@query(
    "behavioural_words_only",
    s.with_ctes(
        "messages",
        " UNION ALL ".join(
            f"SELECT file_id, entry_id, '{n}' AS indicator FROM messages WHERE {s.has_any('lower(message)', spec['words'])}"
            for n, spec in pattern.INDICATORS.items()
        ),
    ),
)
def behavioural_words_only(spark, sf_dir):
    found = pattern.behavioural_indicators(adapt.messages(spark, sf_dir), ["ts", "line_no"], need_evidence=False)
    return found.select("file_id", "entry_id", "indicator")


@query(
    "recon_before_execution",
    s.with_ctes(
        "messages",
        f""", d AS (SELECT source, entry_id, us FROM messages WHERE {_behaves('discovery')}),
        e AS (SELECT source, us FROM messages WHERE {_behaves('execution')})
        SELECT d.source, d.entry_id, round((min(e.us) - d.us) / 1e6, 6) AS gap_seconds FROM d JOIN e
          ON d.source = e.source AND e.us > d.us AND e.us - d.us < 86400000000 GROUP BY 1, 2, d.us""",
    ),
)
def recon_before_execution(spark, sf_dir):
    return rounded(pattern.recon_before_execution(adapt.messages(spark, sf_dir), keys=["source"], within_seconds=86400))


FIELDS_SQL = r""", mf AS (SELECT entry_id, regexp_extract_all(message, 'src[:\s]+(\d+\.\d+\.\d+\.\d+)', 1) AS s,
    regexp_extract_all(message, 'dst[:\s]+(\d+\.\d+\.\d+\.\d+)', 1) AS d, regexp_extract_all(message, '(?i)port[:\s]+(\d+)', 1) AS p FROM messages)"""


@query(
    "message_ip_pairs",
    s.with_ctes(
        "messages",
        FIELDS_SQL + ", x AS (SELECT unnest(s) AS src, d FROM mf), y AS (SELECT src, unnest(d) AS dst FROM x)"
        " SELECT src, dst, count(*) AS mentions FROM y GROUP BY 1, 2",
    ),
)
def message_ip_pairs(spark, sf_dir):
    return pattern.message_ip_pairs(pattern.message_network_fields(adapt.messages(spark, sf_dir)))


@query(
    "message_ports_per_ip",
    s.with_ctes(
        "messages",
        FIELDS_SQL + """, x AS (SELECT unnest(list_concat(s, d)) AS ip, p FROM mf), y AS (SELECT ip, CAST(unnest(p) AS INTEGER) AS port FROM x)
        SELECT ip, count(DISTINCT port) AS ports, count(*) AS events, round(least(count(DISTINCT port) / 50, 0.95), 6) AS confidence
        FROM y GROUP BY 1 HAVING count(DISTINCT port) > 1""",
    ),
)
def message_ports_per_ip(spark, sf_dir):
    fields = pattern.message_network_fields(adapt.messages(spark, sf_dir))
    return rounded(fanout.ports_per_ip(pattern.message_ip_ports(fields), over=1))


def _stage_case():
    rows = []
    for chain, stages in pattern.SEQUENCES.items():
        for n, stage in enumerate(stages):
            rows.append(
                f"SELECT '{chain}' AS chain, {n} AS stage_no, '{stage[0]}' AS stage, name, confidence, found_order FROM pn WHERE {s.has_any('name', stage)}"
            )
    return " UNION ALL ".join(rows)


@query(
    "attack_sequences",
    s.with_ctes(
        "messages",
        ", tg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name FROM messages WHERE {_behaves(n)}" for n in pattern.BEHAVIOURS)
        + "), pn AS (SELECT name, least(count(*) / 10000, 0.95) AS confidence, name AS found_order FROM tg GROUP BY 1), st AS ("
        + _stage_case()
        + """), f AS (SELECT *, row_number() OVER (PARTITION BY chain, stage_no ORDER BY found_order) AS rn FROM st)
        SELECT chain, count(*) AS stages, round(avg(confidence), 6) AS confidence, string_agg(stage || '=' || name, ',' ORDER BY stage_no) AS evidence
        FROM f WHERE rn = 1 GROUP BY 1 HAVING count(*) >= 3""",
    ),
)
def attack_sequences(spark, sf_dir):
    tags = pattern.behaviour_tags(adapt.messages(spark, sf_dir))
    found = tags.groupBy(F.col("behaviour").alias("name")).agg(
        F.least(F.count(F.lit(1)) / 10000, F.lit(0.95)).alias("confidence")
    ).withColumn("found_order", F.col("name"))
    out = pattern.attack_sequences(found)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(e["stage"], F.lit("="), e["pattern"])), ",")
    return rounded(out.withColumn("evidence", shown))


@query(
    "pattern_advice",
    s.with_ctes(
        "messages",
        ", w AS (" + " UNION ALL ".join(
            f"SELECT '{n}' AS name FROM messages WHERE {s.has_any('lower(message)', spec['words'])}" for n, spec in pattern.INDICATORS.items()
        ) + "), a AS " + s.values([[n, "|".join(a)] for n, a in pattern.ADVICE.items()], "name", "advice")
        + f" SELECT name, count(*) AS n, coalesce(any_value(advice), {s.text('|'.join(pattern.DEFAULT_ADVICE))}) AS advice FROM w LEFT JOIN a USING (name) GROUP BY 1",
    ),
)
def pattern_advice(spark, sf_dir):
    found = pattern.behavioural_indicators(adapt.messages(spark, sf_dir), ["ts", "line_no"], need_evidence=False)
    counts = found.groupBy(F.col("indicator").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return pattern.with_advice(counts).withColumn("advice", F.array_join("advice", "|"))

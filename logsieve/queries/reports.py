"""Scores, summaries and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import findings as fnd
from logsieve.operators import ioc
from logsieve.operators.timing import rounded
from logsieve.plans import report
from logsieve.queries import sqlkit as s
from logsieve.queries.correlation import FOUND_SQL, findings
from logsieve.queries.registry import query


def weight_sql(column, table):
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0.5 END"


SCORE = f"{weight_sql('severity', fnd.SEVERITY_WEIGHTS)} * {weight_sql('type', fnd.TYPE_WEIGHTS)} * confidence"


@query("score_findings", s.with_ctes("messages", FOUND_SQL + f" SELECT finding_id, type, severity, round({SCORE}, 6) AS score FROM fd"))
def score_findings(spark, sf_dir):
    found = fnd.score_findings(findings(spark, sf_dir))
    return rounded(found.select("finding_id", "type", "severity", "score"))


@query(
    "findings_by_type",
    s.with_ctes("messages", FOUND_SQL + f" SELECT type, count(*) AS n, round(max({SCORE}), 6) AS max_score, round(avg(confidence), 6) AS mean_confidence FROM fd GROUP BY 1"),
)
def findings_by_type(spark, sf_dir):
    return rounded(fnd.findings_by_type(fnd.score_findings(findings(spark, sf_dir))))


@query("severity_distribution", s.with_ctes("messages", FOUND_SQL + " SELECT severity, count(*) AS n FROM fd GROUP BY 1"))
def severity_distribution(spark, sf_dir):
    return fnd.severity_distribution(findings(spark, sf_dir))


@query(
    "findings_summary",
    s.with_ctes(
        "messages",
        FOUND_SQL + """, t AS (SELECT type, count(*) AS n FROM fd GROUP BY 1 ORDER BY n DESC, type LIMIT 3)
        SELECT (SELECT count(*) FROM fd WHERE severity = 'critical') || ' critical anomalies detected. ' ||
          (SELECT count(*) FROM fd WHERE severity = 'high') || ' high-severity anomalies. Most common: ' ||
          (SELECT string_agg(replace(type, '_', ' '), ', ' ORDER BY n DESC, type) FROM t) || '.' AS summary""",
    ),
)
def findings_summary(spark, sf_dir):
    return fnd.findings_summary(findings(spark, sf_dir))


RESULT_SQL = """, rs AS (SELECT file_id, CASE k % 5 WHEN 0 THEN 'signature' WHEN 1 THEN 'sigma' WHEN 2 THEN 'technique' WHEN 3 THEN 'pattern' ELSE 'anomaly' END AS kind,
      CASE k % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS level,
      CASE k % 3 WHEN 0 THEN 'T1003' ELSE 'T1046' END AS technique, (k % 20) / 20 AS confidence,
      CASE k % 4 WHEN 0 THEN 'Ransomware_X' WHEN 1 THEN 'Persistence' WHEN 2 THEN 'data_exfiltration' ELSE 'other' END AS name
    FROM messages WHERE level = 'error' AND event_type = 'error')"""


def results(spark, sf_dir):
    k = F.col("k")
    pick = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), k % n + 1)
    return adapt.messages(spark, sf_dir).where("level = 'error' AND event_type = 'error'").select(
        "file_id",
        pick(5, ["signature", "sigma", "technique", "pattern", "anomaly"]).alias("kind"),
        pick(7, ["critical", "high", "medium", "low", "low", "low", "low"]).alias("level"),
        pick(3, ["T1003", "T1046", "T1046"]).alias("technique"),
        (k % 20 / 20).alias("confidence"),
        pick(4, ["Ransomware_X", "Persistence", "data_exfiltration", "other"]).alias("name"),
    )


POINTS = """CASE kind WHEN 'signature' THEN CASE level WHEN 'critical' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 10 ELSE 5 END
    WHEN 'sigma' THEN CASE level WHEN 'critical' THEN 18 WHEN 'high' THEN 13 WHEN 'medium' THEN 8 ELSE 3 END
    WHEN 'technique' THEN CASE WHEN technique = 'T1003' THEN 15 ELSE 8 END WHEN 'pattern' THEN 5 ELSE 3 END"""
SCORES_SQL = RESULT_SQL + f""", rep AS (SELECT DISTINCT user_id AS file_id, CAST(user_id % 14 AS BIGINT) AS malicious FROM events),
    ts AS (SELECT r.file_id, least(coalesce(sum({POINTS}), 0) + CASE WHEN malicious > 10 THEN 25 WHEN malicious > 5 THEN 15 WHEN malicious > 0 THEN 10 ELSE 0 END, 100) AS score,
      coalesce(avg(confidence) FILTER (kind IN ('signature', 'sigma', 'technique')), 0.5) AS conf FROM rep r LEFT JOIN rs ON rs.file_id = r.file_id GROUP BY r.file_id, malicious)"""


def scores(spark, sf_dir):
    users = adapt.table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id")).distinct()
    return report.threat_scores(results(spark, sf_dir), users.withColumn("malicious", F.col("file_id") % 14), users)


@query(
    "threat_scores",
    s.with_ctes(
        "messages",
        SCORES_SQL + """ SELECT file_id, CAST(score AS BIGINT) AS threat_score, round(conf, 6) AS confidence, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high'
          WHEN score >= 25 THEN 'medium' ELSE 'low' END AS severity FROM ts""",
    ),
)
def threat_scores(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("file_id", "threat_score", "confidence", "severity"))


@query(
    "key_findings",
    s.with_ctes(
        "messages",
        RESULT_SQL + """ SELECT DISTINCT file_id, kind, name, level, confidence FROM rs WHERE (kind = 'signature' AND level IN ('high', 'critical'))
        OR (kind = 'sigma' AND confidence > 0.7) OR (kind = 'technique' AND confidence > 0.8) OR (kind = 'pattern' AND confidence > 0.75)""",
    ),
)
def key_findings(spark, sf_dir):
    return report.key_findings(results(spark, sf_dir))


@query("executive_summary")
def executive_summary(spark, sf_dir):
    out = report.executive_summary(scores(spark, sf_dir), results(spark, sf_dir))
    return out.withColumn("advice", F.array_join("advice", "|"))


@query(
    "severity_overview",
    s.with_ctes(
        "messages",
        f""", x AS (SELECT file_id, us, {s.first_class('message', __import__('logsieve.functions.text', fromlist=['x']).SEVERITY_WORDS, 'info')} AS sev FROM messages)
        SELECT file_id, count(*) AS entries, count(*) FILTER (sev = 'critical') AS critical, count(*) FILTER (sev = 'high') AS high, count(*) FILTER (sev = 'medium') AS medium,
        count(*) FILTER (sev = 'low') AS low, count(*) FILTER (sev = 'info') AS info, min(us) // 1000000 AS first_s, max(us) // 1000000 AS last_s FROM x GROUP BY 1""",
    ),
)
def severity_overview(spark, sf_dir):
    from logsieve.functions.text import severity_from_message

    lines = adapt.messages(spark, sf_dir).withColumn("severity", severity_from_message(F.col("message")))
    out = report.severity_overview(lines)
    return out.withColumns({"first_s": F.unix_seconds("first_ts"), "last_s": F.unix_seconds("last_ts")}).drop("first_ts", "last_ts")


@query(
    "first_entries",
    s.with_ctes(
        "messages",
        """, r AS (SELECT file_id, entry_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS position FROM messages) SELECT * FROM r WHERE position <= 50""",
    ),
)
def first_entries(spark, sf_dir):
    return report.first_entries(adapt.messages(spark, sf_dir)).select("file_id", "entry_id", "position")


@query(
    "posture",
    s.with_ctes(
        "messages",
        ", c AS (SELECT entry_id, file_id, message AS t FROM messages), raw AS ("
        + s.find_all("c", {k: ioc.BASIC_PATTERNS[k] for k in ("ips", "hashes")}, ["entry_id", "file_id"])
        + """), i AS (SELECT file_id, count(DISTINCT ioc_value) FILTER (kind = 'ips') AS ips, count(DISTINCT ioc_value) FILTER (kind = 'hashes') AS hashes FROM raw GROUP BY 1),
        e AS (SELECT file_id, count(*) FILTER (level = 'critical') AS cr, count(*) FILTER (level = 'error') AS er FROM messages GROUP BY 1),
        p AS (SELECT file_id, cr, er, coalesce(ips, 0) AS ips, coalesce(hashes, 0) AS hashes, greatest(0, 100 - cr * 10 - er * 2 - least(coalesce(ips, 0), 20)) AS sc
              FROM e LEFT JOIN i USING (file_id))
        SELECT file_id, sc AS posture_score, CASE WHEN sc >= 80 THEN 'strong' WHEN sc >= 60 THEN 'moderate' WHEN sc >= 40 THEN 'weak' ELSE 'critical' END AS rating,
          concat_ws('|', CASE WHEN cr > 0 THEN 'Critical severity events detected' END, CASE WHEN er > 10 THEN 'High number of error events' END,
          CASE WHEN ips > 20 THEN 'Excessive number of IP addresses' END, CASE WHEN hashes > 5 THEN 'Multiple file hashes detected' END) AS concerns FROM p""",
    ),
)
def posture(spark, sf_dir):
    lines = adapt.messages(spark, sf_dir)
    out = report.posture(lines, ioc.extract_iocs(lines))
    return out.select("file_id", "posture_score", "rating", F.array_join("concerns", "|").alias("concerns"))


@query(
    "notes",
    s.with_ctes(
        "messages",
        " UNION ALL ".join(
            f"SELECT DISTINCT file_id, '{kind}' AS kind, '{n}' AS note FROM messages WHERE regexp_matches(lower(message), {s.text(p)})"
            for kind, table in (("behaviour", report.BEHAVIOUR_NOTES), ("vulnerability", report.VULNERABILITY_NOTES))
            for n, p in table.items()
        ),
    ),
)
def notes(spark, sf_dir):
    return report.notes(adapt.messages(spark, sf_dir))


@query(
    "combined_level",
    s.with_ctes(
        "messages",
        """, v AS (SELECT entry_id, CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS a, CASE WHEN k >= 80 THEN 4 WHEN k >= 60 THEN 3 WHEN k >= 40 THEN 2 ELSE 1 END AS b,
          CASE WHEN k % 7 >= 5 THEN 4 WHEN k % 7 >= 2 THEN 3 WHEN k % 7 >= 1 THEN 2 END AS c, k FROM messages),
        m AS (SELECT entry_id, (coalesce(a, 0) + b + coalesce(c, 0)) / (CAST(a IS NOT NULL AS INT) + 1 + CAST(c IS NOT NULL AS INT)) AS m, k FROM v)
        SELECT entry_id, CASE WHEN m >= 3.5 THEN 'critical' WHEN m >= 2.5 THEN 'high' WHEN m >= 1.5 THEN 'medium' ELSE 'low' END AS level,
          round((0.8 + CASE WHEN k % 7 > 0 THEN least(0.6 + (k % 7) * 0.1, 0.95) ELSE 0 END) / (1 + CASE WHEN k % 7 > 0 THEN 1 ELSE 0 END), 6) AS confidence FROM m""",
    ),
)
def combined_level(spark, sf_dir):
    k = F.col("k")
    level = F.when(k % 5 == 0, "critical").when(k % 5 == 1, "high").when(k % 5 == 2, "medium").when(k % 5 == 3, "low")
    return rounded(
        adapt.messages(spark, sf_dir).select(
            "entry_id",
            report.combined_level(level, k, k % 7).alias("level"),
            report.combined_confidence(F.lit(0.8), k % 7, F.lit(None).cast("double")).alias("confidence"),
        )
    )


@query(
    "batch_totals",
    s.with_ctes(
        "messages",
        SCORES_SQL + " SELECT count(*) AS files, CAST(max(score) AS BIGINT) AS max_score, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 50) AS urgent_files FROM ts",
    ),
)
def batch_totals(spark, sf_dir):
    return rounded(report.totals(scores(spark, sf_dir)))


@query("log_anomaly_findings")
def log_anomaly_findings(spark, sf_dir):
    """Findings of all log detectors in their common shape."""
    from logsieve.plans.analysis import anomalies

    found = anomalies(adapt.messages(spark, sf_dir))
    return found.select("finding_id", "type", "severity", "confidence", F.round("score", 6).alias("score"), "entity")


@query("file_analysis_scores")
def file_analysis_scores(spark, sf_dir):
    """Scores of all files out of rules, signatures and behaviour patterns."""
    from logsieve.plans.analysis import analyze
    from logsieve.queries.rules import SIGMA, SIGNATURES

    scores = analyze(adapt.messages(spark, sf_dir), SIGMA, SIGNATURES)["scores"]
    return scores.select("file_id", "threat_score", F.round("confidence", 6).alias("confidence"), "severity")

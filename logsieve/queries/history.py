"""History analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators.timing import rounded
from logsieve.plans import history as plan
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

AS_OF = "2024-03-01 00:00:00"
SHOWN = "id, file_name, threat_score, severity, epoch_us(analysis_date) // 1000000 AS at_s"


def shown(df):
    return df.select("id", "file_name", "threat_score", "severity", F.unix_seconds("analysis_date").alias("at_s"))


def as_of():
    return F.lit(AS_OF).cast("timestamp")


FILTERS = dict(start="2024-01-05", end="2024-02-20", min_score=20, file_type="SRC1", has_iocs=True, search="file_")
WHERE = """analysis_date >= '2024-01-05' AND analysis_date <= '2024-02-20' AND threat_score >= 20 AND contains(lower(file_type), 'src1') AND iocs_found > 0
    AND contains(lower(file_name || ' ' || file_hash || ' ' || array_to_string(tags, ' ')), 'file_')"""


@query("search_history", s.with_ctes("history", f"SELECT {SHOWN} FROM history WHERE {WHERE} ORDER BY analysis_date DESC, id DESC LIMIT 20 OFFSET 10"))
def search_history(spark, sf_dir):
    return shown(plan.page(plan.matching(adapt.history(spark, sf_dir), **FILTERS), offset=10, limit=20))


@query("search_history_info", s.with_ctes("history", f"SELECT count(*) AS total, 20 AS \"limit\", 10 AS \"offset\", count(*) > 30 AS has_more FROM history WHERE {WHERE}"))
def search_history_info(spark, sf_dir):
    return plan.page_info(plan.matching(adapt.history(spark, sf_dir), **FILTERS), 10, 20)


RECENT = ", h AS (SELECT * FROM history WHERE analysis_date >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY)"


@query(
    "history_totals",
    s.with_ctes("history", RECENT + " SELECT count(*) AS total_analyses, count(*) FILTER (threat_score > 50) AS threats_found, round(avg(threat_score), 6) AS average_threat_score FROM h"),
)
def history_totals(spark, sf_dir):
    return rounded(plan.history_totals(adapt.history(spark, sf_dir), 30, as_of()))


@query(
    "history_counts",
    s.with_ctes(
        "history",
        RECENT + """ SELECT 'by_severity' AS facet, severity AS value, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'by_file_type', split_part(file_type, '/', 1), count(*) FROM h GROUP BY 2
        UNION ALL SELECT 'by_date', strftime(analysis_date, '%Y-%m-%d'), count(*) FROM h GROUP BY 2""",
    ),
)
def history_counts(spark, sf_dir):
    return plan.history_counts(adapt.history(spark, sf_dir), 30, as_of())


@query("top_techniques", s.with_ctes("history", RECENT + ", t AS (SELECT unnest(mitre_techniques) AS technique FROM h) SELECT technique, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, technique LIMIT 10"))
def top_techniques(spark, sf_dir):
    return plan.top_techniques(adapt.history(spark, sf_dir), 30, as_of())


@query("recent_high_threats", s.with_ctes("history", RECENT + f" SELECT {SHOWN} FROM h WHERE severity IN ('high', 'critical') ORDER BY analysis_date DESC, id DESC LIMIT 10"))
def recent_high_threats(spark, sf_dir):
    return shown(plan.recent_high_threats(adapt.history(spark, sf_dir), 30, as_of()))


IDS = [3, 4, 9]


@query(
    "compare_analyses",
    s.with_ctes("history", "SELECT id, file_name, threat_score, severity, iocs_found, len(mitre_techniques) AS techniques FROM history WHERE id IN (3, 4, 9)"),
)
def compare_analyses(spark, sf_dir):
    return plan.compare(adapt.history(spark, sf_dir), IDS)[0]


@query(
    "compare_common_techniques",
    s.with_ctes(
        "history",
        ", t AS (SELECT DISTINCT id, unnest(mitre_techniques) AS technique FROM history WHERE id IN (3, 4, 9)) SELECT technique FROM t GROUP BY 1 HAVING count(*) = 3",
    ),
)
def compare_common_techniques(spark, sf_dir):
    return plan.compare(adapt.history(spark, sf_dir), IDS)[1]


@query(
    "history_timeline",
    s.with_ctes(
        "history",
        """SELECT strftime(analysis_date, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
        count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM history WHERE analysis_date BETWEEN '2024-01-10' AND '2024-02-10' GROUP BY 1""",
    ),
)
def history_timeline(spark, sf_dir):
    return plan.timeline(adapt.history(spark, sf_dir), "2024-01-10", "2024-02-10")


@query(
    "apply_annotations",
    s.with_ctes(
        "history",
        """, u AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS tag, CASE WHEN quality = 1 THEN 'good' END AS note FROM labels)
        SELECT h.id, array_to_string(list_concat(tags, CASE WHEN u.id IS NULL THEN [] ELSE [tag] END), ',') AS tags, coalesce(note, notes) AS notes FROM history h LEFT JOIN u ON h.id = u.id""",
    ),
)
def apply_annotations(spark, sf_dir):
    updates = adapt.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.array(F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("tags"),
        F.when(F.col("quality") == 1, "good").alias("notes"),
        F.lit(1).alias("updated_at"),
    )
    out = plan.apply_annotations(adapt.history(spark, sf_dir), updates)
    return out.select("id", F.array_join("tags", ",").alias("tags"), "notes")


@query(
    "retain_history",
    s.with_ctes(
        "history",
        f"""SELECT {SHOWN} FROM history WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND analysis_date >= TIMESTAMP '2024-03-01' - INTERVAL 45 DAY
        ORDER BY analysis_date DESC, id DESC LIMIT 300""",
    ),
)
def retain_history(spark, sf_dir):
    gone = adapt.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return shown(plan.retain(adapt.history(spark, sf_dir), 300, 45, as_of(), gone))

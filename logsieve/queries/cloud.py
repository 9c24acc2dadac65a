"""Cloud audit calls made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import cloud_audit
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query
from logsieve.sources import cloud

CALLS = (
    "ListUsers", "DescribeInstances", "GetObject", "CreateAccessKey", "PutUserPolicy", "StopLogging", "DeleteTrail", "Decrypt", "RunInstances", "GetSecretValue",
)
ERRORS = ("", "", "AccessDenied", "Throttling", "")


def records(spark, sf_dir):
    k = F.col("k")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k % len(xs) + 1)
    user = F.col("user")
    obj = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"), pick(CALLS).alias("eventName"), F.lit("iam").alias("eventSource"),
            F.struct(
                F.when(k % 3 == 0, user).alias("userName"), F.when(k % 3 == 1, F.concat(F.lit("arn:aws:sts::1:role/"), user)).alias("arn"),
                F.when(k % 6 == 2, F.concat(F.lit("P-"), user)).alias("principalId"), F.lit("42").alias("accountId"),
            ).alias("userIdentity"),
            F.concat(F.lit("198.51.100."), (F.col("event_id") % 60).cast("string")).alias("sourceIPAddress"),
            F.when(k % 2 == 0, "us-east-1").otherwise("eu-west-1").alias("awsRegion"), F.nullif(pick(ERRORS), F.lit("")).alias("errorCode"),
            F.col("event_id").cast("string").alias("eventID"),
        )
    )
    return adapt.spread(adapt.log_events(spark, sf_dir)).select("event_id", obj.alias("object"))


def calls(spark, sf_dir):
    return cloud.calls(records(spark, sf_dir), keep=())


def _pick(xs):
    return f"[{', '.join(s.text(x) for x in xs)}][k % {len(xs)} + 1]"


RISK = [[k, v] for k, v in cloud.HIGH_RISK_CALLS.items()]
CALLS_SQL = f""", rk AS {s.values(RISK, 'event_name', 'risk')}, c0 AS (SELECT CAST(event_id AS VARCHAR) AS event_id, us, {_pick(CALLS)} AS event_name, {_pick(ERRORS)} AS error_code,
    CASE WHEN k % 3 < 2 THEN "user" WHEN k % 6 = 2 THEN 'P-' || "user" ELSE 'Account-42' END AS "user", '198.51.100.' || (event_id % 60) AS source_ip,
    CASE WHEN k % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-1' END AS region FROM log_events), ca AS (SELECT c0.*, risk FROM c0 LEFT JOIN rk USING (event_name))"""


@query(
    "cloudtrail_calls",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """ SELECT event_id, event_name, "user", source_ip, error_code, CASE WHEN error_code = 'AccessDenied' THEN 'critical' WHEN error_code <> '' OR risk IS NOT NULL THEN 'warning' ELSE 'info' END AS severity,
        event_name || ' by ' || "user" || ' from ' || source_ip || CASE WHEN error_code <> '' THEN ' - ERROR: ' || error_code ELSE '' END AS message,
        concat_ws(',', CASE WHEN risk IS NOT NULL THEN 'high_risk_api' END, replace(lower(risk), ' ', '_'), CASE WHEN error_code <> '' THEN 'error' END,
          CASE WHEN error_code = 'AccessDenied' THEN 'suspicious_error' END) AS tags FROM ca""",
    ),
)
def cloudtrail_calls(spark, sf_dir):
    found = calls(spark, sf_dir)
    return found.select("event_id", "event_name", "user", "source_ip", "error_code", "severity", "message", F.array_join("tags", ",").alias("tags"))


@query(
    "cloud_enumeration",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """ SELECT "user", count(*) AS calls, count(DISTINCT event_name) AS distinct_calls, round((max(us) - min(us)) / 1e6, 6) AS span_seconds FROM ca
        WHERE regexp_matches(event_name, '^(List|Describe|Get)') GROUP BY 1 HAVING count(*) >= 5 AND max(us) - min(us) < 2000000000000""",
    ),
)
def cloud_enumeration(spark, sf_dir):
    found = cloud_audit.enumeration(calls(spark, sf_dir), min_calls=5, within_seconds=2_000_000)
    return rounded(found.drop("first_ts", "last_ts"))


@query(
    "cloud_permission_changes",
    s.with_ctes(
        "log_events",
        CALLS_SQL + f""" SELECT "user", count(*) AS changes, string_agg(DISTINCT event_name, ',' ORDER BY event_name) AS actions, 'critical' AS severity FROM ca
        WHERE event_name IN {cloud_audit.PERMISSION_CALLS} GROUP BY 1 HAVING count(*) >= 3""",
    ),
)
def cloud_permission_changes(spark, sf_dir):
    found = cloud_audit.permission_changes(calls(spark, sf_dir)).drop("first_ts")
    return found.withColumn("actions", F.array_join("actions", ","))


@query(
    "cloud_logging_disabled",
    s.with_ctes(
        "log_events",
        CALLS_SQL + f""" SELECT "user", count(*) AS calls, string_agg(DISTINCT event_name, ',' ORDER BY event_name) AS actions FROM ca WHERE event_name IN {cloud_audit.EVASION_CALLS} GROUP BY 1""",
    ),
)
def cloud_logging_disabled(spark, sf_dir):
    return cloud_audit.logging_disabled(calls(spark, sf_dir)).drop("first_ts").withColumn("actions", F.array_join("actions", ","))


@query(
    "cloud_rapid_calls",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """, l AS (SELECT "user", us, event_id, lead(us, 9) OVER (PARTITION BY "user" ORDER BY us) AS ninth FROM ca),
        h AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY us) AS rn FROM l WHERE ninth - us < 250000000000) SELECT "user", us AS first_us, event_id FROM h WHERE rn = 1""",
    ),
)
def cloud_rapid_calls(spark, sf_dir):
    return cloud_audit.rapid_calls(calls(spark, sf_dir), within_seconds=250_000, segment_seconds=86_400)


@query(
    "cloud_same_calls",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """, b AS (SELECT source_ip FROM ca GROUP BY 1 HAVING count(*) > 5), e AS (SELECT source_ip, event_name, row_number() OVER (PARTITION BY source_ip ORDER BY us, event_id) AS rn FROM ca),
        p AS (SELECT source_ip, string_agg(DISTINCT event_name, ',' ORDER BY event_name) AS pattern FROM e WHERE rn <= 10 AND source_ip IN (SELECT source_ip FROM b) GROUP BY 1)
        SELECT pattern, count(*) AS ip_count, min(source_ip) AS first_ip FROM p GROUP BY 1 HAVING count(*) >= 1""",
    ),
)
def cloud_same_calls(spark, sf_dir):
    return cloud_audit.same_calls_from_many(calls(spark, sf_dir), min_ips=1)


@query("cloud_high_risk_alerts", s.with_ctes("log_events", CALLS_SQL + ' SELECT event_id, event_name, risk, "user" FROM ca WHERE risk IS NOT NULL'))
def cloud_high_risk_alerts(spark, sf_dir):
    return cloud_audit.high_risk_alerts(calls(spark, sf_dir)).select("event_id", "event_name", "risk", "user")


@query(
    "cloud_top_users",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """ SELECT "user", count(*) AS total_events, count(*) FILTER (error_code <> '') AS error_events, count(risk) AS high_risk_events, count(DISTINCT source_ip) AS unique_ips
        FROM ca GROUP BY 1 ORDER BY total_events DESC, "user" LIMIT 10""",
    ),
)
def cloud_top_users(spark, sf_dir):
    return cloud_audit.top_users(calls(spark, sf_dir))


@query(
    "cloud_top_calls",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """ SELECT event_name, count(*) AS n, CASE WHEN max(risk) IS NULL THEN 'normal' ELSE 'high' END AS risk_level, coalesce(max(risk), '') AS risk FROM ca GROUP BY 1 ORDER BY n DESC, event_name LIMIT 20""",
    ),
)
def cloud_top_calls(spark, sf_dir):
    return cloud_audit.top_calls(calls(spark, sf_dir))


@query(
    "cloud_risk_summary",
    s.with_ctes(
        "log_events",
        CALLS_SQL + """ SELECT count(*) AS total_events, round(count(risk) / count(*) * 100, 6) AS high_risk_percentage, round(count(*) FILTER (error_code <> '') / count(*) * 100, 6) AS error_rate,
        count(DISTINCT "user") FILTER (error_code <> '') AS users_with_errors,
        'Audit logging disabled|New access keys created|Privilege escalation attempts|Defense evasion detected|Activity from many different IPs' AS top_risks FROM ca""",
    ),
)
def cloud_risk_summary(spark, sf_dir):
    return rounded(cloud_audit.risk_summary(calls(spark, sf_dir)).withColumn("top_risks", F.array_join("top_risks", "|")))


@query("cloud_calls_by_region", s.with_ctes("log_events", CALLS_SQL + " SELECT region, count(*) AS calls FROM ca GROUP BY 1"))
def cloud_calls_by_region(spark, sf_dir):
    return cloud_audit.calls_by_region(calls(spark, sf_dir))

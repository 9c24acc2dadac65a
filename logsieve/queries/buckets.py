"""Bucket-based detectors over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions.text import is_error
from logsieve.operators import buckets
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

HOURLY = ", b AS (SELECT us // 3600000000 * 3600 AS bucket_s, count(*) AS events, count(*) FILTER (result = 'failed') AS errors FROM log_events GROUP BY 1)"


def _shown(df):
    return rounded(df.withColumn("bucket_s", F.unix_seconds("bucket")).drop("bucket"))


def outliers_sql(source: str, value: str, partition: str = "") -> str:
    """CTE `q`: rows of `source` with n, mean, sd and the index-based quartiles of their key."""
    by = f"PARTITION BY {partition}" if partition else ""
    key = f"{partition}, " if partition else ""
    on = f"USING ({partition})" if partition else "ON true"
    group = f"GROUP BY {partition}" if partition else ""
    return f""", ranked AS (SELECT *, row_number() OVER ({by} ORDER BY {value}) - 1 AS rk, count(*) OVER ({by}) AS cnt FROM {source}),
    base AS (SELECT {key}count(*) AS n_values, avg({value}) AS mean_value, stddev_samp({value}) AS std_value,
             max({value}) FILTER (rk = cnt // 4) AS q1, max({value}) FILTER (rk = 3 * cnt // 4) AS q3 FROM ranked {group}),
    q AS (SELECT * FROM {source} JOIN base {on})"""


def is_outlier(value: str) -> str:
    return (
        f"n_values >= 3 AND ((std_value > 0 AND abs(({value} - mean_value) / std_value) > 3)"
        f" OR {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1))"
    )


@query(
    "volume_anomalies",
    s.with_ctes(
        "log_events",
        HOURLY + outliers_sql("b", "events")
        + f""", m AS (SELECT median(events) AS expected FROM b)
        SELECT bucket_s, events, expected, CASE WHEN events > 3 * expected THEN 'high' ELSE 'medium' END AS severity,
          round(events / expected, 6) AS deviation_ratio FROM q, m WHERE n_values >= 5 AND {is_outlier('events')}""",
    ),
)
def volume_anomalies(spark, sf_dir):
    return _shown(buckets.volume_anomalies(adapt.log_events(spark, sf_dir), seconds=3600))


@query(
    "error_rate_spikes",
    s.with_ctes(
        "log_events",
        HOURLY + """, r AS (SELECT *, errors / events AS rate FROM b),
        z AS (SELECT median(rate) AS med, stddev_samp(rate) AS sd FROM r)
        SELECT bucket_s, events AS total, errors, round(rate, 6) AS error_rate, round(med, 6) AS baseline_rate,
          CASE WHEN rate > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM r, z WHERE rate > med + 2 * sd""",
    ),
)
def error_rate_spikes(spark, sf_dir):
    events = adapt.log_events(spark, sf_dir)
    return _shown(buckets.error_rate_spikes(events, is_error(F.col("result")), seconds=3600))


@query(
    "activity_spikes",
    s.with_ctes(
        "log_events",
        HOURLY + """, z AS (SELECT avg(events) AS m, stddev_samp(events) AS sd FROM b)
        SELECT bucket_s, events, round(m, 6) AS mean_events, round(sd, 6) AS sd_events,
          round(least((events - m) / (sd + 1), 1.0), 6) AS confidence FROM b, z WHERE events > m + 2.5 * sd""",
    ),
)
def activity_spikes(spark, sf_dir):
    return _shown(buckets.activity_spikes(adapt.log_events(spark, sf_dir)))


@query(
    "error_ratio",
    s.with_ctes(
        "messages",
        """, x AS (SELECT count(*) AS total, count(*) FILTER (level = 'error') AS errors FROM messages)
        SELECT total, errors, round(errors / total, 6) AS error_rate, round(least(errors / total * 2, 0.95), 6) AS confidence
        FROM x WHERE total > 100 AND errors / total > 0.1""",
    ),
)
def error_ratio(spark, sf_dir):
    return rounded(buckets.error_ratio(adapt.messages(spark, sf_dir), F.col("level") == "error", over=0.1))


@query(
    "temporal_clusters",
    s.with_ctes(
        "log_events",
        """, b AS (SELECT us // 1800000000 * 1800 AS bucket_s, count(*) AS n FROM log_events GROUP BY 1),
        g AS (SELECT bucket_s AS start_s, lead(bucket_s, 1) OVER w AS b1, lead(bucket_s, 2) OVER w AS end_s,
              n + lead(n, 1) OVER w + lead(n, 2) OVER w AS events FROM b WINDOW w AS (ORDER BY bucket_s))
        SELECT start_s, end_s, events, count(DISTINCT event_type) AS types, count(DISTINCT source) AS sources
        FROM g JOIN log_events e ON us // 1800000000 * 1800 IN (start_s, b1, end_s)
        WHERE end_s IS NOT NULL AND events > 10 GROUP BY 1, 2, 3
        HAVING count(DISTINCT event_type) >= 4 AND count(DISTINCT source) >= 3""",
    ),
)
def temporal_clusters(spark, sf_dir):
    found = buckets.temporal_clusters(adapt.log_events(spark, sf_dir), seconds=1800)
    return found.select(
        F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "events", "types", "sources"
    )


def type_correlation_sql(bins: str, above: str) -> str:
    return s.with_ctes(
        "log_events",
        f""", sp AS (SELECT event_type AS t, min(us) AS f, max(us) AS l FROM log_events GROUP BY 1 HAVING count(*) >= 5),
        p AS (SELECT a.t AS ta, b.t AS tb, least(a.f, b.f) AS st, {bins} AS bins FROM sp a JOIN sp b ON a.t < b.t),
        spine AS (SELECT *, unnest(range(CAST(bins AS BIGINT))) AS bin FROM p),
        h AS (SELECT ta, tb, (e.us - st) // 60000000 AS bin, count(*) FILTER (event_type = ta) AS nx, count(*) FILTER (event_type = tb) AS ny
              FROM p JOIN log_events e ON e.event_type IN (ta, tb) GROUP BY ALL),
        c AS (SELECT spine.*, coalesce(nx, 0) AS x, coalesce(ny, 0) AS y FROM spine LEFT JOIN h USING (ta, tb, bin))
        SELECT ta AS type_a, tb AS type_b, round(greatest(coalesce(corr(x, y), 0), 0), 6) AS correlation FROM c
        GROUP BY 1, 2 HAVING greatest(coalesce(corr(x, y), 0), 0) > {above}""",
    )


MINUTES = "greatest(10, (greatest(a.l, b.l) - least(a.f, b.f)) // 60000000)"


@query("type_correlation", type_correlation_sql(f"{MINUTES} + 1", "-1"))
def type_correlation(spark, sf_dir):
    return rounded(buckets.type_correlation(adapt.log_events(spark, sf_dir), above=-1))


@query("type_correlation_first_bins", type_correlation_sql(f"least({MINUTES}, 100)", "-1"))
def type_correlation_first_bins(spark, sf_dir):
    return rounded(buckets.type_correlation(adapt.log_events(spark, sf_dir), above=-1, max_bins=100))

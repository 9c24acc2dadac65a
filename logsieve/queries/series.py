"""Series detectors over the value of each event type."""

from __future__ import annotations

from logsieve import adapt
from logsieve.operators import series, stats
from logsieve.operators.timing import rounded
from logsieve.queries import sqlkit as s
from logsieve.queries.buckets import is_outlier, outliers_sql
from logsieve.queries.registry import query


@query(
    "stat_outliers",
    "WITH l AS (SELECT doc_id, lang, n_chars FROM documents)"
    + outliers_sql("l", "n_chars", "lang")
    + f""" SELECT doc_id, lang, q1, q3 FROM q WHERE {is_outlier('n_chars')}""",
)
def stat_outliers(spark, sf_dir):
    rows = adapt.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return stats.stat_outliers(rows, "n_chars", ["lang"]).select("doc_id", "lang", "q1", "q3")


@query(
    "ts_outliers",
    s.with_ctes(
        "metrics",
        outliers_sql("metrics", "value", "metric")
        + f""" SELECT metric, event_id, round(value, 6) AS value, round(abs((value - mean_value) / std_value), 6) AS zscore,
        round(mean_value - 2 * std_value, 6) AS expected_low, round(mean_value + 2 * std_value, 6) AS expected_high
        FROM q WHERE n_values >= 10 AND {is_outlier('value')}""",
    ),
)
def ts_outliers(spark, sf_dir):
    return rounded(series.ts_outliers(adapt.metrics(spark, sf_dir)).drop("ts"))


@query(
    "trend_change",
    s.with_ctes(
        "metrics",
        """, o AS (SELECT metric, event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY metric) AS n,
           avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
           avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM metrics WINDOW w AS (PARTITION BY metric ORDER BY us, event_id))
        SELECT metric, event_id, i AS row_index, round(b, 6) AS before, round(a, 6) AS after, round(abs(a - b) / b, 6) AS magnitude
        FROM o WHERE i >= 5 AND i < n - 5 AND abs(a - b) / b > 0.5""",
    ),
)
def trend_change(spark, sf_dir):
    found = series.trend_change(adapt.metrics(spark, sf_dir), order_by=["ts", "event_id"])
    return rounded(found.drop("ts", "value"))


@query(
    "seasonal",
    s.with_ctes(
        "metrics",
        """, o AS (SELECT metric, event_id, value, (row_number() OVER (PARTITION BY metric ORDER BY us, event_id) - 1) % 24 AS slot,
           count(*) OVER (PARTITION BY metric) AS n FROM metrics),
        e AS (SELECT *, avg(value) OVER (PARTITION BY metric, slot) AS expected FROM o WHERE n > 100)
        SELECT metric, event_id, slot, round(expected, 6) AS expected, round(abs(value - expected) / expected, 6) AS deviation
        FROM e WHERE expected > 0 AND round(abs(value - expected) / expected, 12) > 1""",
    ),
)
def seasonal(spark, sf_dir):
    found = series.seasonal(adapt.metrics(spark, sf_dir), order_by=["ts", "event_id"])
    return rounded(found.select("metric", "event_id", "slot", "expected", "deviation"))

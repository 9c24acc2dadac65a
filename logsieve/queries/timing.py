"""Gap-based detectors over events and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import ordered, timing
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query
from logsieve.queries.scalars import template_sql


def gaps(source: str, key: str, ties: str = "") -> str:
    """CTE `g`: per row the seconds to the row before of the same key."""
    return f""", o AS (SELECT {key}, us, (us - lag(us) OVER (PARTITION BY {key} ORDER BY us{ties})) / 1e6 AS gap FROM {source}),
    g AS (SELECT {key}, count(*) AS n_events, count(gap) AS n_gaps, min(gap) AS min_gap, avg(gap) AS mean_gap,
          stddev_samp(gap) AS std_gap, stddev_pop(gap) AS pop_gap, avg(gap) FILTER (gap > 0) AS mean_pos,
          stddev_samp(gap) FILTER (gap > 0) AS std_pos, count(gap) FILTER (gap > 0) AS n_pos,
          count(gap) FILTER (gap < 10) AS rapid, max(gap) AS widest FROM o GROUP BY {key})"""


@query(
    "rapid_fire",
    s.with_ctes(
        "log_events",
        gaps("log_events", "source")
        + " SELECT source, n_events, round(min_gap, 6) AS min_gap FROM g WHERE n_events >= 5 AND min_gap < 60",
    ),
)
def rapid_fire(spark, sf_dir):
    return timing.rounded(timing.rapid_fire(adapt.log_events(spark, sf_dir), below=60))


@query(
    "automated_activity",
    s.with_ctes(
        "log_events",
        gaps("log_events", "source")
        + """ SELECT source, n_events, round(1 - std_gap / mean_gap, 6) AS regularity, round(mean_gap, 6) AS mean_gap
            FROM g WHERE n_gaps > 10 AND mean_gap > 0 AND std_gap / mean_gap < 0.9""",
    ),
)
def automated_activity(spark, sf_dir):
    return timing.rounded(timing.automated_activity(adapt.log_events(spark, sf_dir), cv_below=0.9))


@query(
    "beaconing",
    s.with_ctes(
        "flows",
        """, o AS (SELECT dst, us, (us - lag(us) OVER (PARTITION BY dst ORDER BY us)) / 1e6 AS gap FROM flows),
        g AS (SELECT dst, count(*) AS n, avg(gap) FILTER (gap > 0) AS m, stddev_samp(gap) FILTER (gap > 0) AS sd FROM o GROUP BY 1)
        SELECT dst, n AS connections, round(1 / (1 + coalesce(sd, 0) / m), 6) AS beacon_score, round(m, 6) AS mean_positive_gap
        FROM g WHERE n > 10 AND 1 / (1 + coalesce(sd, 0) / m) > 0.5""",
    ),
)
def beaconing(spark, sf_dir):
    flows = adapt.flows(spark, sf_dir)
    return timing.rounded(timing.beaconing(flows, ["dst"], score_above=0.5))


TEMPLATED = f""", t AS (SELECT *, {template_sql('message')} AS template FROM messages)"""


@query(
    "rapid_succession",
    s.with_ctes(
        "messages",
        TEMPLATED + gaps("t", "template")
        + """ SELECT template, n_events, rapid AS rapid_gaps, round(mean_gap, 6) AS average_interval,
            round(least(rapid / 10, 0.95), 6) AS confidence FROM g WHERE n_events >= 5 AND rapid >= 1""",
    ),
)
def rapid_succession(spark, sf_dir):
    lines = timing.by_template(adapt.messages(spark, sf_dir))
    return timing.rounded(timing.rapid_succession(lines, min_rapid=1))


@query(
    "periodic",
    s.with_ctes(
        "messages",
        TEMPLATED + gaps("t", "template")
        + """ SELECT template, n_events, round(mean_pos, 6) AS period, round(std_pos, 6) AS deviation,
            round(1 - std_pos / mean_pos, 6) AS confidence FROM g WHERE n_events >= 5 AND n_pos >= 4 AND std_pos / mean_pos < 1""",
    ),
)
def periodic(spark, sf_dir):
    return timing.rounded(timing.periodic(timing.by_template(adapt.messages(spark, sf_dir)), cv_below=1.0))


@query(
    "burst",
    s.with_ctes(
        "log_events",
        """, o AS (SELECT source, us, (us - lag(us) OVER (PARTITION BY source ORDER BY us)) / 1e6 AS gap FROM log_events),
        a AS (SELECT source, gap AS widest, us AS start_us, count(*) OVER (PARTITION BY source) AS n,
              row_number() OVER (PARTITION BY source ORDER BY gap DESC NULLS LAST, us) AS rn FROM o)
        SELECT a.source, start_us AS burst_start_us, round(widest, 6) AS quiet_seconds, count(*) AS burst_events,
               round(least(count(*) / 20, 0.9), 6) AS confidence
        FROM a JOIN o ON o.source = a.source AND o.us BETWEEN start_us AND start_us + 172800000000
        WHERE rn = 1 AND n >= 3 AND widest > 3600 GROUP BY ALL HAVING count(*) >= 3""",
    ),
)
def burst(spark, sf_dir):
    found = timing.burst(adapt.log_events(spark, sf_dir), key="source", burst_seconds=172_800, min_events=3)
    return timing.rounded(found)


@query(
    "c2_beacon",
    s.with_ctes(
        "flows",
        gaps("flows", "dst_port")
        + """ SELECT dst_port, n_events AS beacons, round(mean_gap, 6) AS average_interval,
            round(coalesce(std_gap, 0), 6) AS deviation FROM g
            WHERE n_events >= 5 AND mean_gap > 30 AND coalesce(std_gap, 0) < mean_gap * 0.6""",
    ),
)
def c2_beacon(spark, sf_dir):
    return timing.rounded(timing.c2_beacon(adapt.flows(spark, sf_dir), key="dst_port", spread=0.6))


@query(
    "c2_communication",
    s.with_ctes(
        "flows",
        """, o AS (SELECT src, dst, us, (us - lag(us) OVER (PARTITION BY src, dst ORDER BY us)) / 1e6 AS gap FROM flows),
        g AS (SELECT src, dst, count(*) AS n, avg(gap) AS m, stddev_pop(gap) / nullif(avg(gap), 0) AS cv, min(us) AS first_us FROM o GROUP BY 1, 2)
        SELECT g.src, g.dst, n AS n_events, round(m, 6) AS mean_gap, round(cv, 6) AS cv, count(*) AS process_events
        FROM g JOIN (SELECT o_custkey, epoch_us(o_orderdate) AS ous FROM orders) p
          ON p.o_custkey = g.src AND ous BETWEEN first_us AND first_us + 4320000000000
        WHERE n >= 3 AND m > 0 AND cv < 0.8 GROUP BY ALL""",
    ),
)
def c2_communication(spark, sf_dir):
    processes = adapt.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("ts"))
    found = timing.c2_communication(
        adapt.flows(spark, sf_dir), processes, keys=["src", "dst"], min_events=3, cv_below=0.8, within_seconds=50 * 86400
    )
    return timing.rounded(found)


@query(
    "late_night",
    "SELECT hour(ts) AS hour, count(*) AS events FROM events WHERE hour(ts) <= 4 GROUP BY 1 HAVING count(*) > 5",
)
def late_night(spark, sf_dir):
    return timing.late_night(adapt.log_events(spark, sf_dir))


@query(
    "previous_event",
    s.with_ctes(
        "flows",
        """SELECT flow_id, src, coalesce(lag(dst) OVER w, -1) AS prev_dst FROM flows
        WINDOW w AS (PARTITION BY src ORDER BY us, l_orderkey, l_linenumber, dst, dst_port)""",
    ),
)
def previous_event(spark, sf_dir):
    """The row before, per key, with windows cut into time segments."""
    found = ordered.previous_row(
        adapt.flows(spark, sf_dir), ["src"], ["ts", "l_orderkey", "l_linenumber", "dst", "dst_port"], ["dst"], segment_seconds=86400 * 90
    )
    return found.select("flow_id", "src", F.coalesce("prev_dst", F.lit(-1)).alias("prev_dst"))

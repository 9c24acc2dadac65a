"""Outliers by density and by isolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import density, forest
from logsieve.queries.registry import query


@query(
    "cluster_noise",
    """WITH f AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM f),
    z AS (SELECT event_id, (value - mv) / sv AS a, (k - mk) / sk AS b FROM f, m),
    n AS (SELECT x.event_id, count(*) AS neighbours FROM z x JOIN z y ON (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.01 GROUP BY 1),
    c AS (SELECT z.* FROM z JOIN n USING (event_id) WHERE neighbours >= 5)
    SELECT event_id, neighbours FROM n JOIN z x USING (event_id) WHERE neighbours < 5 AND NOT EXISTS
      (SELECT 1 FROM c WHERE (x.a - c.a) * (x.a - c.a) + (x.b - c.b) * (x.b - c.b) <= 0.01)""",
)
def cluster_noise(spark, sf_dir):
    events = adapt.table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return density.cluster_noise(events, "event_id", ["value", "k"], eps=0.1).select("event_id", "neighbours")


MANY = ("value", "k", "who", "hour", "words")
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in MANY)


def _near(a: str, b: str, eps: float) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in MANY) + f" <= {eps * eps}"


@query(
    "cluster_noise_of_many_features",
    f"""WITH f AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id::DOUBLE AS who, hour(ts)::DOUBLE AS hour, length(event_type)::DOUBLE AS words FROM events),
    z AS (SELECT event_id, {_Z} FROM f),
    n AS (SELECT x.event_id, count(*) AS neighbours FROM z x JOIN z y ON {_near("x", "y", 0.5)} GROUP BY 1),
    c AS (SELECT z.* FROM z JOIN n USING (event_id) WHERE neighbours >= 5)
    SELECT event_id, neighbours FROM n JOIN z x USING (event_id) WHERE neighbours < 5 AND NOT EXISTS (SELECT 1 FROM c WHERE {_near("x", "c", 0.5)})""",
)
def cluster_noise_of_many_features(spark, sf_dir):
    events = adapt.table(spark, sf_dir, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("who"),
        F.hour("ts").cast("double").alias("hour"), F.length("event_type").cast("double").alias("words"),
    )
    return density.cluster_noise(events, "event_id", MANY, eps=0.5).select("event_id", "neighbours")


@query("traffic_outliers")
def traffic_outliers(spark, sf_dir):
    """One tenth of all flows, those easiest to set apart by size, packets and price of the order."""
    flows = adapt.flows(spark, sf_dir).select(
        F.concat_ws("/", "flow_id", "dst", "dst_port", F.col("bytes").cast("string")).alias("row_id"), F.col("bytes").alias("bytes_sent"),
        (F.col("bytes") / F.col("packets")).alias("bytes_received"), F.col("packets").alias("packet_count"),
    )
    return forest.traffic_outliers(flows, "row_id").select("row_id")


@query("generic_outliers")
def generic_outliers(spark, sf_dir):
    customers = adapt.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return forest.generic_outliers(customers, "c_custkey").select("c_custkey")

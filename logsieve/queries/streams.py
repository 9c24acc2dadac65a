"""Streams over files that Spark writes from the tables, run until nothing is left and read back from their history; sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators.sigma import SigmaRule
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query
from logsieve.session import shared_path
from logsieve.sources import sinks as tables
from logsieve.streaming import recent, sinks, state, windows

DONE = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 4 HOUR FROM events)"  # the watermark after all rows


def streamed(spark: SparkSession, parts: list[DataFrame], build: Callable[[Callable[[], DataFrame]], DataFrame], one_by_one: bool = False) -> DataFrame:
    """What a stream over these tables has written to its history; each table is a file of its own, in order."""
    folder, out = shared_path(spark, "stream-in"), shared_path(spark, "stream-out")
    for part in parts:
        (part.coalesce(1) if one_by_one else part).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(parts[0].schema)
    if one_by_one:
        reader = reader.option("maxFilesPerTrigger", 1)
    running = sinks.append_to_history(build(lambda: reader.parquet(folder)), out, shared_path(spark, "stream-checkpoint"))
    running.awaitTermination()
    return spark.read.parquet(out).drop("stream", "written_at")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query(
    "stream_volume",
    f"""SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS bucket_s, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors,
      count(*) FILTER (event_type = 'error') / count(*) AS error_rate FROM events GROUP BY time_bucket(INTERVAL 5 MINUTE, ts)
      HAVING time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= {DONE}""",
)
def stream_volume(spark, sf_dir):
    found = streamed(spark, [events(spark, sf_dir)], lambda read: windows.volume(windows.event_window(read()), F.col("event_type") == "error"))
    return found.select(F.unix_seconds("bucket").alias("bucket_s"), "events", "errors", "error_rate")


@query("stream_scans")
def stream_scans(spark, sf_dir):
    """Sources with many distinct users in a sliding hour; the stream counts by sketch, so there is no SQL."""
    rows = events(spark, sf_dir).select(F.concat(F.lit("host-"), F.col("user_id") % 4).alias("src"), "user_id", "ts")
    found = streamed(spark, [rows], lambda read: windows.scans(windows.event_window(read()), "user_id", size="1 hour", slide="30 minutes", at_least=3))
    return found.select("src", F.unix_seconds("bucket").alias("bucket_s"), "distinct_values", "flows")


@query(
    "stream_bursts",
    f"""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 1 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 3600000000 AS quiet_until_us, count(*) AS events FROM n GROUP BY user_id, run
    HAVING count(*) >= 2 AND max(ts) + INTERVAL 1 HOUR <= {DONE}""",
)
def stream_bursts(spark, sf_dir):
    found = streamed(spark, [events(spark, sf_dir)], lambda read: windows.bursts(windows.event_window(read()), "user_id", min_events=2))
    return found.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("quiet_until").alias("quiet_until_us"), "events")


@query("stream_distinct_events", "SELECT event_id, event_type FROM events")
def stream_distinct_events(spark, sf_dir):
    """Every event arrives twice."""
    rows = events(spark, sf_dir).withColumn("source", F.col("user_id").cast("string"))
    return streamed(spark, [rows.unionByName(rows)], lambda read: windows.distinct_events(windows.event_window(read()))).select("event_id", "event_type")


@query(
    "stream_followed_by",
    """SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error'
      AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""",
)
def stream_followed_by(spark, sf_dir):
    kind = F.col("event_type")
    found = streamed(spark, [events(spark, sf_dir)], lambda read: windows.followed_by(read().where(kind == "click"), read().where(kind == "error"), ["user_id"], "2 hours"))
    return found.select("user_id", "first_id", "then_id")


@query("stream_enrich", "SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id")
def stream_enrich(spark, sf_dir):
    customers = adapt.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return streamed(spark, [events(spark, sf_dir)], lambda read: windows.enrich(read(), customers, "user_id")).select("event_id", "c_mktsegment")


@query("stream_history", "SELECT event_id, 'errors' AS rule FROM events WHERE event_type = 'error'")
def stream_history(spark, sf_dir):
    """Rule matches appended to the history, file by file."""
    rule = SigmaRule("errors", "errors", {"selection": {"event_type": "error"}, "condition": "selection"})
    rows = events(spark, sf_dir)
    parts = [rows.where(F.col("ts") < "2024-01-15"), rows.where(F.col("ts") >= "2024-01-15")]
    found = streamed(spark, parts, lambda read: windows.match_rules(read(), [rule], ["event_id"]), one_by_one=True)
    return found.select("event_id", F.lit(rule.title).alias("rule"))


@query(
    "stream_brute_force",
    """WITH f AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type = 'error'),
    l AS (SELECT e.user_id, e.ts, f.ts AS last, f.before FROM events e ASOF JOIN f ON e.user_id = f.user_id AND e.ts > f.ts WHERE e.event_type <> 'error')
    SELECT user_id, epoch_us(ts) AS success_us, epoch_us(before) AS first_failure_us FROM l WHERE ts - before <= INTERVAL 12 HOUR""",
)
def stream_brute_force(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return streamed(spark, [rows], lambda read: state.brute_force(read(), ["user_id"], failures=2, within_seconds=12 * 3600)).select("user_id", "success_us", "first_failure_us")


@query(
    "stream_last_events",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS back, count(*) OVER (PARTITION BY user_id) AS seen FROM events)
    SELECT user_id, seen, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM n WHERE back <= 25 GROUP BY 1, 2""",
)
def stream_last_events(spark, sf_dir):
    """The last 25 events of each user; the files come out of order."""
    before = spark.conf.get(recent.PROVIDER)
    spark.conf.set(recent.PROVIDER, recent.STATE_STORE)
    try:
        rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
        late = F.col("ts") < "2024-01-12"
        found = streamed(spark, [rows.where(~late), rows.where(late)], lambda read: recent.last_events(read(), ["user_id"], size=25), one_by_one=True)
    finally:
        spark.conf.set(recent.PROVIDER, before)
    newest = found.groupBy("user_id").agg(F.max_by(F.struct("seen", "events", "first_us", "last_us"), "seen").alias("r"))
    return newest.select("user_id", "r.*")


@query("dated_entries", s.with_ctes("messages", "SELECT entry_id, CAST(ts AS DATE)::VARCHAR AS event_date, level, message FROM messages"))
def dated_entries(spark, sf_dir):
    """Entries written by day, in two appends, and read back."""
    folder, rows = shared_path(spark, "entries"), adapt.messages(spark, sf_dir)
    for level in (rows.where("level = 'error'"), rows.where("level <> 'error'")):
        tables.write_dated(level, folder)
    return spark.read.parquet(folder).select("entry_id", F.col("event_date").cast("string").alias("event_date"), "level", "message")


@query("exported_entries", s.with_ctes("messages", "SELECT entry_id, message, k, '[\"' || source || '\",\"' || \"user\" || '\"]' AS names FROM messages"))
def exported_entries(spark, sf_dir):
    """Entries exported as CSV, with an array as text, and read back."""
    folder = shared_path(spark, "export")
    tables.export_rows(adapt.messages(spark, sf_dir).select("entry_id", "message", "k", F.array("source", "user").alias("names")), folder, "csv")
    return spark.read.csv(folder, header=True, schema="entry_id string, message string, k int, names string", escape="\\")

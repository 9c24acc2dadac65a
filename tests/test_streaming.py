"""Streams give what the batch operators give on the same rows."""

import random
import uuid

import pytest
from conftest import at
from pyspark.sql import functions as F

from logsieve.operators import correlate, timing
from logsieve.operators.sigma import SigmaRule
from logsieve.streaming import sinks, state, windows


def run(stream, mode="append"):
    name = "t" + uuid.uuid4().hex[:8]
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", "error"]), at(i * 30)) for i in range(400)]
    rows.append((9999, "z", "x", at(400 * 30 + 40_000)))  # moves the watermark past all the others
    path = str(tmp_path_factory.mktemp("events"))
    # later rows come first within a file, which is in order across files
    spark.createDataFrame(sorted(rows, key=lambda r: -r[0]), "event_id int, source string, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, path):
    return spark.readStream.schema("event_id int, source string, event_type string, ts timestamp").parquet(path)


def test_volume(spark, events):
    got = run(windows.volume(windows.event_window(stream_of(spark, events)), F.col("event_type") == "error"))
    batch = spark.read.parquet(events).where("event_id < 9999").groupBy(F.window("ts", "5 minutes").start.alias("bucket")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    assert sorted(map(tuple, got.select("bucket", "events", "errors").collect())) == sorted(map(tuple, batch.collect()))


def test_scans_and_bursts(spark, events):
    flows = windows.event_window(stream_of(spark, events)).withColumnRenamed("source", "src")
    got = run(windows.scans(flows, "event_id", size="10 minutes", slide="10 minutes", at_least=5))
    assert got.count() > 0 and got.agg(F.min("distinct_values")).first()[0] >= 5
    sessions = run(windows.bursts(windows.event_window(stream_of(spark, events)), "source"))
    assert {r.source for r in sessions.collect()} == {"a", "b"}


def test_duplicates(spark, events, tmp_path):
    twice = spark.read.parquet(events).union(spark.read.parquet(events))
    twice.write.parquet(str(tmp_path / "d"))
    got = run(windows.distinct_events(windows.event_window(stream_of(spark, str(tmp_path / "d")))))
    assert got.count() == spark.read.parquet(events).count()


def test_followed_by(spark, events):
    kind = F.col("event_type")
    got = run(
        windows.followed_by(
            stream_of(spark, events).where(kind == "x"), stream_of(spark, events).where(kind == "error"), ["source"], "10 minutes"
        )
    )
    batch = correlate.followed_by(spark.read.parquet(events), kind == "x", {"errors": kind == "error"}, "event_id", within_seconds=600)
    counts = {r.first_id: r["count"] for r in got.groupBy("first_id").count().collect()}
    assert counts == {r.event_id: int(r.errors) for r in batch.collect()} and counts


def test_beaconing(spark, tmp_path):
    rows = [("a", "b", at(60 * i)) for i in range(30)] + [("a", "c", at(i * i * 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "src string, dst string, ts timestamp")
    for n in range(3):
        df.where(
            (F.unix_seconds("ts") >= 1704067200 + 600 * n) & (F.unix_seconds("ts") < (1704067200 + 600 * (n + 1) if n < 2 else 2_000_000_000))
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("src string, dst string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    got = run(state.beaconing(stream), "update")
    last = got.orderBy(F.desc("connections")).first()
    (batch,) = timing.beaconing(df).collect()
    assert (last.dst, last.connections) == ("b", 30) and last.beacon_score == pytest.approx(batch.beacon_score)


def test_brute_force(spark, tmp_path):
    rows = [("t", "s", at(i), True) for i in range(5)] + [("t", "s", at(10), False), ("t", "q", at(11), False)]
    rows += [("u", "s", at(i * 300), True) for i in range(5)] + [("u", "s", at(1300), False)]
    spark.createDataFrame(rows, "target string, source string, ts timestamp, failed boolean").coalesce(1).write.parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema("target string, source string, ts timestamp, failed boolean").parquet(str(tmp_path / "l"))
    got = run(state.brute_force(stream)).collect()
    assert [(r.target, r.source) for r in got] == [("t", "s")]


def test_last_events_with_late_files(spark, tmp_path, monkeypatch):
    """The last N by time, though a later file brings older rows; an idle key is forgotten."""
    from logsieve.streaming import recent

    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), at(rng.randrange(5000))) for i in range(500)] + [(900, "c", None), (901, "d", at(3))]
    files = [[r for r in rows if r[0] % 3 == n] for n in (2, 0, 1)]
    schema = "event_id int, source string, ts timestamp"
    for part in [*files, [(1000, "late", at(90_000))], [(1001, "d", at(90_001))]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(recent.PROVIDER)
    spark.conf.set(recent.PROVIDER, recent.STATE_STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        summary = run(recent.last_events(stream, ["source"], size=40, idle_ms=3600 * 1000)).collect()
        content = run(recent.last_events(stream, ["source"], size=40, content=True)).collect()
    finally:
        spark.conf.set(recent.PROVIDER, before)
    micros = lambda r: int((r[2] - at(0)).total_seconds() * 1e6) + 1704067200_000_000
    for key in "ab":
        own = sorted((micros(r), str(r[0])) for r in rows if r[1] == key)
        last = max((r for r in summary if r.source == key), key=lambda r: r.seen)
        assert (last.seen, last.events, last.first_us, last.last_us) == (len(own), 40, own[-40][0], own[-1][0])
        assert [(r.us, r.id) for r in content if r.source == key and r.seen == len(own)] == own[-40:]
    assert not [r for r in summary if r.source == "c"]
    assert [r.seen for r in summary if r.source == "d"] == [1, 1] and max(r.seen for r in content if r.source == "d") == 2


def test_enrichment_rules_and_history(spark, events, tmp_path):
    feed = spark.createDataFrame([("a", "bad")], "source string, verdict string")
    enriched = windows.enrich(stream_of(spark, events), feed, "source")
    query = sinks.append_to_history(enriched, str(tmp_path / "h"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "h"))
    expected = spark.read.parquet(events).where("source = 'a'").count()
    assert written.count() == expected and written.agg(F.min("verdict")).first()[0] == "bad"
    rule = SigmaRule("r", "t", {"selection": {"event_type": "error"}, "condition": "selection"})
    matched = run(windows.match_rules(stream_of(spark, events), [rule], ["event_id"]))
    assert matched.count() == spark.read.parquet(events).where("event_type = 'error'").count()


def test_history_of_two_streams_in_one_path(spark, tmp_path):
    from logsieve.streaming import sinks

    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):
        stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
        assert sinks.append_to_history(stream, str(tmp_path / "h"), str(tmp_path / checkpoint)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2

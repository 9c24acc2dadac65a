"""Sketch tables, the stored history and parsers brought by the user."""

import json
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsieve.operators import sketches
from logsieve.plans import history as plan
from logsieve.plans import stored_history
from logsieve.sources import parsers

START = datetime(2024, 1, 1)


def test_distinct_counts_from_daily_sketches(spark):
    n = 200_000
    rows = spark.range(n).select(
        F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("user"),
        F.pmod(F.xxhash64("id"), F.lit(40_000)).alias("value"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 4) * 86_400).alias("ts"),
    )
    early, late = rows.where("ts < '2024-01-03'"), rows.where("ts >= '2024-01-02'").where("value % 2 = 0")
    tables = [sketches.daily_sketches(df, ["user"], "value") for df in (early, late)]
    both = sketches.merged(tables, ["user"])
    assert both.count() == 12 and both.schema["sketch"].dataType.simpleString() == "binary"
    exact = {r.user: (r.n, r.d) for r in early.unionByName(late).groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("d")).collect()}
    got = {r.user: (r.events, r.distinct_values) for r in sketches.distinct_between(both, ["user"]).collect()}
    assert got.keys() == exact.keys()
    for user, (events, distinct) in exact.items():
        assert got[user][0] == events and abs(got[user][1] - distinct) <= 0.02 * distinct
    one_day = sketches.distinct_between(both, ["user"], start="2024-01-04", end="2024-01-04").first()
    assert one_day.events < exact["u0"][0] and sketches.distinct_between(both, ["user"], over=10**6).count() == 0


def test_sketches_of_nulls_and_rolling_days(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 2, 1), ("a", 3, 3), ("b", None, 0), (None, 5, 1), (None, 6, 2)]
    df = spark.createDataFrame([(u, v, START + timedelta(days=d)) for u, v, d in rows], "user string, value long, ts timestamp")
    daily = sketches.daily_sketches(df, ["user"], "value")
    assert {(r.user, r.events, r.distinct_values) for r in sketches.distinct_between(daily, ["user"], over=-1).collect()} == {("a", 4, 3), ("b", 1, 0), (None, 2, 2)}
    rolled = {(r.user, r.day.day, r.events, r.distinct_values) for r in sketches.rolling_distinct(daily, ["user"], 2).collect()}
    assert rolled == {("a", 1, 2, 2), ("a", 2, 3, 2), ("a", 4, 1, 1), ("b", 1, 1, 0), (None, 2, 1, 1), (None, 3, 2, 2)}
    assert sketches.daily_sketches(df.limit(0), ["user"], "value").count() == 0


@pytest.fixture
def stored(spark):
    """A table of 60 analyses over ten days, and its rows."""
    rows = [(i, START + timedelta(hours=4 * i), ["old"], f"note {i}") for i in range(60)]
    history = spark.createDataFrame(rows, "id long, analysis_date timestamp, tags array<string>, notes string")
    name = f"history_{uuid.uuid4().hex}"
    stored_history.create(history, name)
    yield name, history
    spark.sql(f"DROP TABLE {name}")


def files_by_day(spark, table):
    """Names of the files that hold each day."""
    spark.catalog.refreshTable(table)
    out = {}
    for r in spark.table(table).select(stored_history.DAY, F.input_file_name().alias("f")).distinct().collect():
        out.setdefault(r[0], set()).add(r.f)
    return out


def rows_of(df):
    return sorted((r.id, r.analysis_date, tuple(r.tags), r.notes) for r in df.collect())


def test_annotations_rewrite_touched_days_only(spark, stored):
    name, history = stored
    before = files_by_day(spark, name)
    updates = spark.createDataFrame([(7, ["new"], "seen", 1), (8, ["x"], None, 1), (999, ["none"], "nowhere", 1)], "id long, tags array<string>, notes string, updated_at long")
    assert stored_history.annotate(spark, name, updates) == [date(2024, 1, 2)]
    after = files_by_day(spark, name)
    assert before.keys() == after.keys() and [d for d in before if before[d] != after[d]] == [date(2024, 1, 2)]
    assert rows_of(spark.table(name)) == rows_of(plan.apply_annotations(history, updates))
    assert stored_history.annotate(spark, name, updates.where("id = 999")) == []


@pytest.mark.parametrize("newest,days,deleted", [(20, None, []), (18, None, []), (None, 3, []), (25, 6, [58, 40, 41, 3]), (None, None, [12, 13, 14, 15, 16, 17, 30]), (0, None, [])])
def test_retention_touches_border_days_only(spark, stored, newest, days, deleted):
    name, history = stored
    as_of = "2024-01-10 21:00:00"
    gone = spark.createDataFrame([(i,) for i in deleted], "id long")
    before = files_by_day(spark, name)
    rewritten, dropped = stored_history.retain(spark, name, newest, days, as_of, gone)
    after = files_by_day(spark, name)
    assert sorted(before.keys() - after.keys()) == dropped
    assert sorted(d for d in after if after[d] != before[d]) == rewritten
    expected = plan.retain(history, newest, days, F.lit(as_of), gone)
    assert rows_of(spark.table(name)) == rows_of(expected)


def test_appended_days(spark, stored):
    name, history = stored
    stored_history.append(history.where("id < 2").withColumn("id", F.col("id") + 100), name)
    assert spark.table(name).count() == 62 and stored_history.retain(spark, name) == ([], [])


def handlers():
    """Two parsers; classes of a function travel to the executors by value."""

    class KeyValues:
        def eval(self, text: str):
            for part in (text or "").split():
                key, sign, value = part.partition("=")
                if sign:
                    yield key, value

    class JsonPairs:
        def eval(self, text: str):
            try:
                found = json.loads(text or "")
            except ValueError:
                return
            if isinstance(found, dict):
                for key, value in found.items():
                    yield key, str(value)

    return KeyValues, JsonPairs


def test_parsers_of_the_user(spark):
    key_values, json_pairs = handlers()
    parsers.register_parser(spark, parsers.Parser("key_values", key_values, "key string, value string", (".kv",)))
    parsers.register_parser(spark, parsers.Parser("json_pairs", json_pairs, "key string, value string", (".json", ".JSONL")))
    lines = spark.createDataFrame(
        [(1, "a.kv", "x=1 y=2 z"), (2, "B.JSON", '{"p": 3}'), (3, "c.jsonl", "broken {"), (4, None, "q=9"), (5, "d.kv", None), (6, "e.log", "x=1")],
        "n long, path string, line string",
    )
    pairs = lambda df: {(r.n, r.key, r.value) for r in df.collect()}
    assert pairs(parsers.parse_with(lines, "key_values", "line")) == {(1, "x", "1"), (1, "y", "2"), (4, "q", "9"), (6, "x", "1")}
    assert pairs(parsers.parse_with(lines, "json_pairs", "line")) == {(2, "p", "3")}
    by_file = parsers.parse_files(lines, "path", "line", ["key_values", "json_pairs"])
    assert pairs(by_file["key_values"]) == {(1, "x", "1"), (1, "y", "2")} and pairs(by_file["json_pairs"]) == {(2, "p", "3")}
    assert {r.n for r in by_file["text"].collect()} == {4, 6}
    lines.createOrReplaceTempView("parser_lines")
    assert pairs(spark.sql("SELECT n, key, value FROM parser_lines, LATERAL key_values(line) WHERE n = 1")) == {(1, "x", "1"), (1, "y", "2")}
    with pytest.raises(ValueError):
        parsers.parse_with(lines, "unknown", "line")
    with pytest.raises(ValueError):
        parsers.parse_with(lines.withColumnRenamed("n", "KEY"), "key_values", "line")

"""Segmented windows against brute force, whatever the width of a segment."""

import random
import statistics

import pytest
from conftest import at
from pyspark.sql import functions as F

from logsieve.operators import ordered


def make_rows(seed=1, n=400):
    rng = random.Random(seed)
    # one key holds most rows, and times repeat
    keys = ["hot"] * 6 + ["a", "b", "c"]
    return [(i, rng.choice(keys), rng.randrange(0, 5000) / 2, rng.choice("xyz"), rng.random() < 0.3) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, k, at(s), v, f) for i, k, s, v, f in rows], "id long, key string, ts timestamp, v string, flag boolean").cache()


@pytest.mark.parametrize("segment", [7, 300, 100_000])
def test_gap_stats(table, rows, segment):
    found = {r.key: r for r in ordered.gap_stats(table, ["key"], rapid_below=1.0, segment_seconds=segment).collect()}
    for key in {r[1] for r in rows}:
        times = sorted(s for _, k, s, _, _ in rows if k == key)
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        r = found[key]
        assert r.n_events == len(times) and r.n_gaps == len(gaps)
        assert r.min_gap == pytest.approx(min(gaps)) and r.mean_gap == pytest.approx(statistics.mean(gaps))
        assert r.std_gap == pytest.approx(statistics.stdev(gaps)) and r.pop_std_gap == pytest.approx(statistics.pstdev(gaps))
        positive = [g for g in gaps if g > 0]
        assert r.n_positive_gaps == len(positive) and r.std_positive_gap == pytest.approx(statistics.stdev(positive))
        assert r.rapid_gaps == sum(g < 1 for g in gaps)
        widest = max(gaps)
        first_end = times[gaps.index(widest) + 1]
        assert r.widest_gap == pytest.approx(widest)
        assert r.widest_gap_end_us == int((1704067200 + first_end) * 1e6)


def test_gap_stats_of_single_rows(spark):
    df = spark.createDataFrame([("a", at(1)), ("b", None), (None, at(2))], "key string, ts timestamp")
    (row,) = ordered.gap_stats(df, ["key"]).collect()
    assert (row.key, row.n_events, row.n_gaps, row.min_gap, row.mean_gap) == ("a", 1, 0, None, None)


@pytest.mark.parametrize("segment", [10, 100_000])
def test_previous_row_and_index(table, rows, segment):
    prev = {r.id: r.prev_id for r in ordered.previous_row(table, ["key"], ["ts", "id"], ["id"], segment_seconds=segment).collect()}
    index = {r.id: (r.row_index, r.key_rows) for r in ordered.row_index(table, ["key"], ["ts", "id"], segment_seconds=segment).collect()}
    for key in {r[1] for r in rows}:
        own = sorted((s, i) for i, k, s, _, _ in rows if k == key)
        for n, (_, i) in enumerate(own):
            assert prev[i] == (own[n - 1][1] if n else None)
            assert index[i] == (n, len(own))


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_neighbour_frames(table, rows, chunk):
    indexed = ordered.row_index(table, ["key"], ["ts", "id"])
    framed = ordered.neighbour_frames(
        indexed, ["key"], "row_index", 2, 3, {"before": (F.sum("id"), -2, -1), "after": (F.max("id"), 0, 3)}, chunk_rows=chunk
    ).collect()
    assert len(framed) == len(rows)
    for r in framed:
        own = [i for _, i in sorted((s, i) for i, k, s, _, _ in rows if k == r.key)]
        n = r.row_index
        earlier = own[max(0, n - 2) : n]
        assert r.before == (sum(earlier) if earlier else None) and r.after == max(own[n : n + 4])


@pytest.mark.parametrize("segment", [20, 100_000])
@pytest.mark.parametrize("start", [True, False])
def test_range_profile(table, rows, segment, start):
    found = ordered.range_profile(
        table, ["key"], F.col("flag"), ["id"], {"n": F.lit(1.0), "x": (F.col("v") == "x").cast("double")}, before_seconds=30, after_seconds=60,
        include_start=start, next_of={"y": F.col("v") == "y"}, segment_seconds=segment,
    ).collect()
    assert len(found) == sum(r[4] for r in rows)
    by_id = {i: (k, s) for i, k, s, _, _ in rows}
    for r in found:
        key, t = by_id[r.id]
        inside = [v for _, k, s, v, _ in rows if k == key and (t - 30 <= s if start else t - 30 < s) and s <= t + 60]
        assert r.n == len(inside) and r.x == inside.count("x")
        later = [s for _, k, s, v, _ in rows if k == key and s > t and v == "y"]
        assert r.y_us == (int((1704067200 + min(later)) * 1e6) if later else None)


@pytest.mark.parametrize("segment", [20, 100_000])
def test_distinct_in_following(table, rows, segment):
    found = ordered.distinct_in_following(table, ["key"], "v", F.col("flag"), ["id"], 45, segment_seconds=segment).collect()
    by_id = {i: (k, s) for i, k, s, _, _ in rows}
    assert len(found) == sum(r[4] for r in rows)
    for r in found:
        key, t = by_id[r.id]
        assert r.distinct_v == len({v for _, k, s, v, _ in rows if k == key and t <= s <= t + 45})


def test_result_does_not_depend_on_partitions(spark, table):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = ordered.gap_stats(table.repartition(int(n)), ["key"]).select("key", "n_events", F.round("std_gap", 9).alias("s")).collect()
            results.append(sorted(map(tuple, rows)))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

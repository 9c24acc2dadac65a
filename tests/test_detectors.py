"""Expectations at the thresholds."""

import pytest
from conftest import at
from pyspark.sql import functions as F

from logsieve.functions import clock, net
from logsieve.functions import text as txt
from logsieve.functions.predicates import EventFields
from logsieve.operators import buckets, correlate, fanout, findings, intel, ioc, pattern, series, stats, timing


def test_one_outlier(spark):
    df = spark.createDataFrame([(float(v),) for v in [10, 12, 11, 13, 12, 11, 10, 12, 100, 11, 12, 10]], "value double")
    assert [r.value for r in stats.stat_outliers(df, "value").collect()] == [100.0]


def test_outliers_need_three_values(spark):
    df = spark.createDataFrame([(1.0,), (1000.0,)], "value double")
    assert stats.stat_outliers(df, "value").count() == 0


def test_rapid_fire_threshold(spark):
    rows = [("fast", at(i * 0.05)) for i in range(5)] + [("four", at(i * 0.05)) for i in range(4)] + [("edge", at(i * 0.1)) for i in range(6)]
    df = spark.createDataFrame(rows, "source string, ts timestamp")
    assert [r.source for r in timing.rapid_fire(df).collect()] == ["fast"]


def test_beaconing_of_regular_pairs(spark):
    rows = [("a", "b", at(60 * i)) for i in range(12)] + [("a", "c", at(60 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "src string, dst string, ts timestamp")
    (row,) = timing.beaconing(df).collect()
    assert (row.dst, row.connections, row.beacon_score) == ("b", 12, 1.0)


def test_burst_takes_first_widest_gap(spark):
    times = [0, 1, 2] + [7300 + i for i in range(12)] + [20000]
    df = spark.createDataFrame([("t", at(s)) for s in times], "template string, ts timestamp")
    assert timing.burst(df).collect() == []  # the widest gap is before the last, single event
    df = spark.createDataFrame([("t", at(s)) for s in times[:-1]], "template string, ts timestamp")
    (row,) = timing.burst(df).collect()
    assert row.burst_events == 12 and row.quiet_seconds == 7298


def test_port_scan_needs_more_than_twenty(spark):
    rows = [("s", "d", p) for p in range(1, 22)] + [("s", "e", p) for p in range(1, 21)] + [(None, "d", 1), ("s", "d", 0)]
    df = spark.createDataFrame(rows, "src string, dst string, dst_port int")
    (row,) = fanout.port_scan(df, sample=3).collect()
    assert (row.dst, row.ports, row.sample_ports) == ("d", 21, [1, 2, 3])


def test_impossible_travel(spark):
    rows = [("u", "NO", at(0)), ("u", "NO", at(10)), ("u", "SE", at(7209)), ("u", "SE", at(20000)), ("u", "NO", at(27200))]
    df = spark.createDataFrame(rows, "user string, country string, ts timestamp")
    found = fanout.impossible_travel(df, segment_seconds=60).collect()
    assert [(r.prev_country, r.country, r.gap_seconds) for r in found] == [("NO", "SE", 7199.0)]


def test_error_rate_spikes_empty_input(spark):
    df = spark.createDataFrame([], "ts timestamp, level string")
    assert buckets.error_rate_spikes(df, txt.is_error(F.col("level"))).count() == 0
    assert buckets.volume_anomalies(df).count() == 0


def test_volume_anomaly(spark):
    rows = [(at(300 * b + i),) for b in range(8) for i in range(5)] + [(at(3000 + i),) for i in range(60)]
    (row,) = buckets.volume_anomalies(spark.createDataFrame(rows, "ts timestamp")).collect()
    assert (row.events, row.severity, row.expected) == (60, "high", 5.0)


def test_trend_change_by_hand(spark):
    values = [1.0] * 6 + [2.0] * 6
    df = spark.createDataFrame([("m", at(i), v) for i, v in enumerate(values)], "metric string, ts timestamp, value double")
    found = {r.row_index: r.magnitude for r in series.trend_change(df).collect()}
    assert found == {5: pytest.approx(0.8), 6: pytest.approx(1.0)}


def brute_slices(events, failures=5, rows=11, minimum=6, within=600):
    out = []
    for i in range(len(events) - minimum + 1):
        part, n, source, ok = events[i : i + rows], 0, None, False
        for when, kind, src in part:
            if kind == "fail":
                n, source = n + 1, source or src
            elif kind == "ok" and n >= failures and src == source:
                ok = True
                break
        if ok and part[-1][0] - part[0][0] <= within:
            out.append((i, n))
    return out


def test_brute_force_slices_against_loop(spark):
    import random

    rng = random.Random(5)
    events = [(i * 20, rng.choice(["fail", "fail", "fail", "ok"]), rng.choice("pq")) for i in range(120)]
    df = spark.createDataFrame([(i, "t", s, k, at(t)) for i, (t, k, s) in enumerate(events)], "id int, target string, source string, kind string, ts timestamp")
    found = correlate.brute_force_slices(df, F.col("kind") == "fail", F.col("kind") == "ok", ["ts", "id"])
    expected = brute_slices(events)
    assert expected and sorted((r.id, r.failed_attempts) for r in found.collect()) == expected


def test_three_failures_are_no_brute_force(spark):
    rows = [(i, "10.0.0.1", a, at(i)) for i, a in enumerate(["fail", "fail", "fail", "ok"])]
    df = spark.createDataFrame(rows, "id int, source string, kind string, ts timestamp")
    for n, expected in ((5, 0), (3, 1)):
        found = correlate.brute_force(df, F.col("kind") == "fail", F.col("kind") == "ok", "id", ["source"], failures=n)
        assert found.count() == expected


def test_followed_by_excludes_same_time_and_includes_limit(spark):
    rows = [(1, "s", "a", at(0)), (2, "s", "b", at(0)), (3, "s", "b", at(3600)), (4, "s", "b", at(3601))]
    df = spark.createDataFrame(rows, "event_id int, source string, kind string, ts timestamp")
    (row,) = correlate.followed_by(df, F.col("kind") == "a", {"b": F.col("kind") == "b"}, "event_id").collect()
    assert row.b == 1.0


def test_ioc_expectations(spark):
    text = (
        "from 192.168.1.100 and 10.0.0.1 not 256.1.1.1, malware.evil.com phishing-site.net d41d8cd98f00b204e9800998ecf8427e "
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855 mail admin@evil.com see http://evil.com/a?b=1"
    )
    df = spark.createDataFrame([("e", "f", text)], "entry_id string, file_id string, message string")
    found = {}
    for r in ioc.extract_iocs(df).collect():
        found.setdefault(r.ioc_type, set()).add(r.ioc_value)
    assert found["ips"] == {"192.168.1.100", "10.0.0.1"}
    assert {"malware.evil.com", "phishing-site.net"} <= found["domains"]
    assert len(found["hashes"]) == 2 and found["emails"] == {"admin@evil.com"}
    advanced = {(r.kind, r.ioc_value) for r in ioc.extract_advanced(df).collect()}
    assert not any(k in ("ipv4", "md5", "sha256") for k, _ in advanced)  # private addresses, hashes of nothing
    assert ("domain", "malware.evil.com") in advanced


def test_long_paths_do_not_exhaust_the_stack(spark):
    df = spark.createDataFrame([("e", "f", "/a" * 20_000 + " " + "QUJD" * 20_000)], "entry_id string, file_id string, message string")
    kinds = {r.kind for r in ioc.extract_advanced(df).collect()}
    assert {"unix_path", "base64"} <= kinds


def test_needed_words_lose_no_match(spark):
    """Every pattern finds the same with and without the test that lets a text skip it."""
    import random

    random.seed(7)
    wallet = "4A" + "".join(random.choice("123456789ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(93))
    parts = [
        "10.1.2.3", "8.8.8.8:53", "a.b.example.org", "EXAMPLE.com.", "https://x.io/a.exe?b", "http://évil.com/ü", "x@y.zz", "C:\\a\\b.exe", "/etc/passwd", "HKLM\\x.y", "HKU",
        "1:2:3:4:5:6:7:8", "::1", "fe80::", "1:2:3:4:5:6:7", ":::", "CVE-2024-12345", "cve-2024-1", "-enc AAAA", "-EncodedCommand QUJD", "cmd /c dir", "sh -c", "bash -Command x", "é", " ", "\n",
        "1" + "a" * 26, "bc1" + "q" * 39, "0x" + "aB" * 20, wallet, "d41d8cd98f00b204e9800998ecf8427e", "QUJD" * 11 + "==", "f" * 128, "f" * 64, "f" * 40,
    ]
    texts = [(i, "".join(random.choice([p, p + " "]) for p in random.choices(parts, k=random.randint(0, 6)))) for i in range(400)] + [(400, ""), (401, None)]
    df = spark.createDataFrame(texts, "entry_id int, message string")
    for patterns in (ioc.BASIC_PATTERNS, ioc.ADVANCED_PATTERNS, ioc.MORE_PATTERNS):
        found = {tuple(r) for r in ioc.extract(df, F.col("message"), patterns, ["entry_id"]).collect()}
        plain = set()
        for kind, pattern in patterns.items():
            value = F.explode(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(ioc.POSSESSIVE.get(kind, pattern)), F.lit(0))).alias("v")
            plain |= {(r.entry_id, kind, r.v.lower() if kind in ioc.LOWERED else r.v) for r in df.select("entry_id", value).collect()}
        assert found == plain and {k for _, k, _ in plain} == set(patterns)


def test_report_severity(spark):
    df = spark.createDataFrame([("file", 45, 5, 10, 5, 0, "")], "resource_type string, malicious int, suspicious int, harmless int, undetected int, reputation int, categories string")
    (row,) = intel.report_severity(df).collect()
    assert round(row.detection_rate, 1) == 76.9 and row.severity == "critical"


@pytest.mark.parametrize(
    "ip,private,public",
    [("10.1.2.3", True, False), ("172.32.0.1", False, True), ("172.16.0.1", True, False), ("8.8.8.8", False, True), ("256.1.1.1", False, False),
     ("::1", True, False), ("2001:4860::8888", False, True), (None, False, False), ("", False, False)],
)
def test_ip_classes(spark, ip, private, public):
    df = spark.createDataFrame([(ip,)], "ip string")
    row = df.select(net.is_private_ip(F.col("ip")).alias("a"), net.is_public_ip(F.col("ip")).alias("b")).first()
    assert (row.a, row.b) == (private, public)


def test_timestamps(spark):
    values = ["2024-01-01T00:00:05Z", "2024-01-01 00:00:05", "01/Jan/2024:00:00:05 +0000", "1704067205", "1704067205000", "1704067205000000", "Jan  1 00:00:05", "nothing"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(F.unix_seconds(clock.normalize_timestamp(F.col("v"), 2024))).collect()]
    assert got == [1704067205] * 7 + [None]


def test_durations(spark):
    df = spark.createDataFrame([(93784,), (0,), (59,)], "s long")
    shown = [r[0] for r in df.select(clock.format_duration(F.col("s"))).collect()]
    assert shown == ["1d 2h 3m 4s", "0s", "59s"]
    back = spark.createDataFrame([(x,) for x in shown + ["5m", "x"]], "t string").select(clock.parse_duration(F.col("t"))).collect()
    assert [r[0] for r in back] == [93784, 0, 59, 300, None]


def test_template_order(spark):
    text = "2024-01-01T10:00:00 User 550e8400-e29b-41d4-a716-446655440000 from 10.1.1.1 port 22"
    row = spark.createDataFrame([(text,)], "m string").select(txt.normalize_message(F.col("m"))).first()
    assert row[0] == "user uuid from ip port num"


def test_context_needed_for_escalation(spark):
    lines = [("f", i, at(i), m) for i, m in enumerate(["x"] * 6 + ["sudo ls"] + ["x"] * 4 + ["access granted", "y"])]
    df = spark.createDataFrame(lines, "file_id string, line_no int, ts timestamp, message string").withColumn("entry_id", F.col("line_no"))
    found = pattern.behavioural_indicators(df, ["line_no"]).collect()
    assert [(r.entry_id, r.indicator, r.confidence) for r in found] == [(6, "privilege_escalation", pytest.approx(0.7))]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "type string, severity string")
    assert findings.findings_summary(empty).first().summary == "No significant anomalies detected."


def test_predicates_never_yield_null(spark):
    df = spark.createDataFrame([(None, None)], "message string, user string")
    e = EventFields(df)
    row = df.select(e.is_login(), e.is_failed_login(), e.is_privileged(), e.is_large_transfer(), e.is_suspicious_access()).first()
    assert not any(row) and None not in row

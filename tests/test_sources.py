"""Readers over small files."""

import gzip
import json

import pytest

from logsieve.operators import fanout, traffic
from logsieve.sources import cloud, csvlogs, inventory, jsonlogs, lines, logcat, registry, sinks, text, zeek


def write(path, content):
    path.write_text(content)
    return str(path)


def test_line_numbers_over_splits(spark, tmp_path):
    body = "\n".join(f"line {i}" for i in range(1, 2001))
    path = write(tmp_path / "a.log", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        rows = lines.read_lines(spark, path)
        got = {r.line_no: r.line for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"line {i}" for i in range(1, 2001)}


def test_text_logs(spark, tmp_path):
    path = write(
        tmp_path / "mix.log",
        "Jan 15 10:00:01 server sshd: Accepted password for admin from 10.0.0.5\n"
        '192.168.1.1 - - [15/Jan/2024:10:00:03 +0000] "GET /admin HTTP/1.1" 401 128\n\n'
        "2024-01-01 10:00:05 ERROR Failed login attempt from 192.168.1.100\nodd line\n",
    )
    rows = {r.pattern_type: r for r in text.read_text_logs(spark, path, year=2024).collect()}
    assert rows["syslog_like"].source == "server" and rows["access_log"].severity == "high"
    assert rows["iso_timestamp"].severity == "high" and rows[None].unstructured


def test_stack_traces(spark, tmp_path):
    path = write(
        tmp_path / "trace.log",
        "start\njava.lang.NullPointerException: x\n\tat a.b.C\n\tat a.b.D\nother\nTraceback (most recent call last):\n"
        '  File "x.py", line 1\nValueError: bad\n\tat not.a.java.frame\n',
    )
    rows = {r.line_no: r for r in text.stitch_multiline(lines.read_lines(spark, path)).collect()}
    assert (rows[2].lines, rows[2].message) == (3, "Java Exception: java.lang.NullPointerException")
    assert (rows[6].lines, rows[6].message) == (3, "ValueError: bad") and len(rows) == 2


def test_stack_trace_is_cut_at_fifty_lines(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "long.log", "my.FooException: x\n" + "\tat a.b.C\n" * 80)
    (row,) = text.stitch_multiline(lines.read_lines(spark, path), max_lines=text.MAX_LINES).collect()
    assert row.lines == 50
    for chunk in (text.CHUNK_LINES, 7):  # without a limit all lines, over any number of chunks
        monkeypatch.setattr(text, "CHUNK_LINES", chunk)
        (row,) = text.stitch_multiline(lines.read_lines(spark, path)).collect()
        assert row.lines == 81 and row.raw_data.count("\n") == 80


def test_csv(spark, tmp_path):
    path = write(tmp_path / "data.csv", "timestamp;src_ip;user;action\n2024-01-15 10:00:00;192.168.1.1;bob;ALLOW\n2024-01-15 10:00:01;10.0.0.1;eve;BLOCK\n")
    assert csvlogs.find_delimiter(["a;b;c", "1;2;3"]) == ";" and csvlogs.find_delimiter(["plain"]) == ","
    rows = csvlogs.read_csv_logs(spark, path).collect()
    assert {r.ip_addresses[0] for r in rows} == {"192.168.1.1", "10.0.0.1"} and all(r.ts for r in rows)


def test_json_shapes(spark, tmp_path):
    write(tmp_path / "lines.json", '{"level":"ERROR","message":"boom"}\n{"level":"INFO","message":"ok"}\n')
    write(tmp_path / "array.json", json.dumps([{"message": "a"}, {"message": "b"}, {"message": "c"}], indent=1))
    write(tmp_path / "wrapped.json", json.dumps({"meta": 1, "events": [{"message": "d"}]}))
    rows = jsonlogs.read_json_logs(spark, str(tmp_path / "*.json")).collect()
    assert sorted(r.message for r in rows) == ["a", "b", "boom", "c", "d", "ok"]
    as_lines = jsonlogs.read_json_logs(spark, str(tmp_path / "lines.json"), lines=True).collect()
    assert {r.severity for r in as_lines} == {"high", "info"}


def test_cloudtrail_gzip(spark, tmp_path):
    record = {"eventTime": "2024-01-01T00:00:00Z", "eventName": "StopLogging", "eventSource": "x", "userIdentity": {"arn": "arn:aws:sts::1:role/eve"}, "errorCode": "AccessDenied"}
    path = tmp_path / "trail.json.gz"
    path.write_bytes(gzip.compress(json.dumps({"Records": [record, record]}).encode()))
    rows = cloud.read_cloudtrail(spark, str(path)).collect()
    assert len(rows) == 2 and rows[0].user == "eve" and rows[0].severity == "critical"


def test_zeek(spark, tmp_path):
    path = write(
        tmp_path / "conn.log",
        "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tconn_state\torig_bytes\tlocal_orig\n"
        "#types\ttime\tstring\taddr\tport\taddr\tport\tenum\tstring\tstring\tcount\tbool\n1704067200.5\tC1\t10.0.0.1\t4444\t8.8.8.8\t53\tudp\t-\tREJ\t12\tT\n",
    )
    (row,) = zeek.read_zeek_typed(spark, path).collect()
    assert (row.log_type, row.source_port, row.service, row.severity, row.suspicious) == ("connection", 4444, "", "warning", ["suspicious_port"])


def test_zeek_folder_of_different_logs(spark, tmp_path):
    write(tmp_path / "conn.log", "#fields\tts\tuid\tproto\tservice\tconn_state\torig_bytes\n#types\ttime\tstring\tenum\tstring\tstring\tcount\n1.5\tC1\tudp\t-\tSF\t12\n")
    write(tmp_path / "conn.2.log", "#fields\tuid\tts\tproto\tconn_state\torig_bytes\n#types\tstring\ttime\tenum\tstring\tcount\nC2\t2.5\ttcp\tREJ\t\n#close\tx\n\n")
    write(tmp_path / "dns.log", "#fields\tts\tuid\ttrans_id\tquery\tqtype_name\n#types\ttime\tstring\tcount\tstring\tstring\n3.5\tD1\t7\ta.example\tA\n")
    rows = {r.uid: r for r in zeek.read_zeek(spark, str(tmp_path)).collect()}
    assert (rows["C1"].ts, rows["C1"].proto, rows["C1"].query, rows["C1"].service, rows["C1"].orig_bytes) == (1.5, "udp", None, None, 12)
    assert (rows["C2"].ts, rows["C2"].proto, rows["C2"].conn_state, rows["C2"].orig_bytes) == (2.5, "tcp", "REJ", None)
    assert (rows["D1"].query, rows["D1"].trans_id, rows["D1"].proto) == ("a.example", 7, None)
    assert {r.uid for r in zeek.read_zeek_typed(spark, str(tmp_path), "conn").collect()} == {"C1", "C2"}
    assert [r.query for r in zeek.read_zeek_typed(spark, str(tmp_path), "dns").collect()] == ["a.example"]
    with pytest.raises(ValueError, match="several kinds"):
        zeek.read_zeek_typed(spark, str(tmp_path))


def test_logcat_and_registry(spark, tmp_path):
    path = write(tmp_path / "d.logcat", "01-15 10:00:00.123  100  200 E ActivityManager: crash\nE/Tag( 12): x\nnoise\n")
    rows = {r.format: r for r in logcat.read_logcat(spark, path, 2024).collect()}
    assert rows["threadtime"].tid == 200 and rows["brief"].ts is None and rows["threadtime"].severity == "error"
    path = write(tmp_path / "run.reg", 'Windows Registry Editor Version 5.00\n\n[HKEY_LOCAL_MACHINE\\A\\Run]\n"x"="C:\\\\a.exe"\n[-HKEY_CURRENT_USER\\Old]\n')
    kinds = {(r.event_type, r.key_path, r.value_data) for r in registry.read_reg_export(spark, path).collect()}
    assert ("registry_value", "HKEY_LOCAL_MACHINE\\A\\Run", "C:\\a.exe") in kinds and len(kinds) == 3


def test_inventory(spark, tmp_path):
    write(tmp_path / "a.pcap", "x")
    write(tmp_path / "b.unknown", "2024-01-01 00:00:00 hello")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in inventory.read_inventory(spark, str(tmp_path)).collect()}
    assert (rows["a.pcap"].kind, rows["a.pcap"].confidence) == ("pcap", 0.9)
    assert (rows["b.unknown"].kind, rows["b.unknown"].method) == ("timestamp_log", "content")


def test_large_unknown_file_gets_its_kind(spark, tmp_path):
    with (tmp_path / "big.unknown").open("w") as out:
        line = "2024-01-01 00:00:00 hello " + "x" * 1000 + "\n"
        for _ in range(66):
            out.write(line * 1000)
    write(tmp_path / "name with # and ü.weird", "From: a@b.c\nSubject: x\n")
    (tmp_path / "zeros.bin2").write_bytes(bytes(70 << 20))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in inventory.read_inventory(spark, str(tmp_path)).collect()}
    assert rows["big.unknown"].length > 64 << 20 and (rows["big.unknown"].kind, rows["zeros.bin2"].kind) == ("timestamp_log", "binary")
    whole = {r.path.rsplit("/", 1)[-1]: r.kind for r in inventory.read_inventory(spark, str(tmp_path / "*#*"), ranged_schemes=()).collect()}
    assert len(whole) == 1 and set(whole.values()) == {"email_headers"} and len(rows) == 3


FIVE = {"a.csv": ",", "b.csv": "\t", "c.csv": "|", "d.csv": ";", "e.csv": ":"}


def five_files(folder, header=True):
    rows = [("2024-01-15 10:00:00", "192.168.1.1", "bob", "ALLOW", 'say "hi"', "h1"), ("", "10.0.0.1", " eve ", "BLOCK", "", "h2"), ("x", "", "", "", "", "")]
    for n, (name, sep) in enumerate(FIVE.items()):
        skip = 1 if sep == ":" else n % 2
        kept = [[v if '"' not in v else '"' + v.replace('"', '""') + '"' for v in r[skip:]] for r in rows]
        names = ["timestamp", "src_ip", "user", "action", "note", "host"][skip:]
        write(folder / name, "\n".join(["", *([sep.join(names)] if header else []), *map(sep.join, kept), ""]))
    return rows


def test_csv_folder_of_five_delimiters(spark, tmp_path):
    five_files(tmp_path)
    shown = lambda r: (r.ts, r.source, r.event_type, r.severity, r.message, r.users, r.ip_addresses, sorted(r.metadata.items()))
    together = csvlogs.read_csv_logs(spark, str(tmp_path)).collect()
    assert {r.file_id.rsplit("/", 1)[-1] for r in together} == set(FIVE)
    for name, sep in FIVE.items():
        alone = csvlogs.csv_entries(csvlogs.read_csv(spark, str(tmp_path / name), sep).drop("_corrupt_record")).collect()
        assert sorted(map(str, map(shown, alone))) == sorted(str(shown(r)) for r in together if r.file_id.endswith(name)), name


def test_csv_dialects(spark, tmp_path):
    five_files(tmp_path)
    write(tmp_path / "short.csv", "user,user,action\neve,bob\neve,bob,ALLOW,more\n")
    write(tmp_path / "empty.csv", "\n\n")
    found = {r.file_id.rsplit("/", 1)[-1]: r for r in csvlogs.csv_dialects(spark, str(tmp_path)).collect()}
    assert {n: found[n].delimiter for n in FIVE} == FIVE and "empty.csv" not in found
    assert list(found["short.csv"].columns) == ["user0", "user1", "action"]
    rows = csvlogs.read_csv_rows(spark, str(tmp_path / "short.csv")).collect()
    assert sorted(((tuple(r["values"]), r.corrupt) for r in rows), key=str) == [(("eve", "bob", "ALLOW"), True), (("eve", "bob", None), True)]
    write(tmp_path / "quoted.csv", 'a;b\n"x;""y""";2\n;"1,2"\n')
    quoted = csvlogs.read_csv_rows(spark, str(tmp_path / "quoted.csv"), ";").collect()
    assert [(tuple(r["values"]), r.corrupt) for r in quoted] == [(('x;"y"', "2"), False), ((None, "1,2"), False)]
    bare = csvlogs.read_csv_rows(spark, str(tmp_path / "a.csv"), has_header=False).collect()
    assert len(bare) == 4 and bare[0]["columns"][0] == "_c0" and csvlogs.read_csv_logs(spark, str(tmp_path / "empty.csv")).count() == 0


def test_flow_csv(spark, tmp_path):
    path = write(
        tmp_path / "flows.csv",
        "src_addr,dst_addr,src_port,dst_port,protocol,packets,bytes,tcp_flags,first,last\n10.0.0.1,10.0.0.2,1,80,6,3,100,0,2024-01-01 00:00:00,2024-01-01 00:00:05\n",
    )
    (row,) = traffic.flows(spark.read.csv(path, header=True)).collect()
    assert (row.protocol, row.duration, row.flag_tags, row.severity) == ("TCP", 5.0, ["null_scan"], "warning")


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-02 03:00:00' AS ts, array('a') AS tags")
    sinks.write_dated(df, str(tmp_path / "out"))
    sinks.write_dated(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2 and str(back.first().event_date) == "2024-01-02"
    sinks.export_rows(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().tags == '["a"]'


def test_protocol_mismatch(spark):
    df = spark.createDataFrame([(80, "HTTP"), (80, "ssh"), (80, "tcp"), (443, None), (9999, "x")], "dst_port int, protocol string")
    assert [(r.dst_port, r.protocol) for r in fanout.protocol_mismatch(df).collect()] == [(80, "ssh")]

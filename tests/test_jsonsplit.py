"""JSON files read by split against the json module."""

import json
import random

import pytest

from logsieve.sources import cloud, jsonlogs, jsonsplit


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", " ", "😀"], k=rng.randrange(9)))
    if kind == 3:
        return rng.choice([1, -2.5, True, None])
    if kind == 4:
        return {}
    if kind < 7:
        return {f"k{i}{rng.choice(['', '}', '[', chr(34)])}": value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def record(rng, i):
    return {"message": f"m{i}", "body": value(rng), "n": i}


def found(df):
    return sorted(json.dumps(json.loads(r.object), sort_keys=True) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_of_all_shapes(spark, tmp_path, small_splits):
    rng = random.Random(4)
    many = [record(rng, i) for i in range(400)]
    files, expected = {}, []

    def file(name, text, *records):
        files[name] = text
        (tmp_path / f"{name}.json").write_text(text)
        expected.extend(json.dumps(r, sort_keys=True) for r in records)

    file("array", json.dumps(many), *many)
    file("pretty", json.dumps(many, indent=2, ensure_ascii=False) + "\n", *many)
    file("lines", "\n".join(map(json.dumps, many[:150])) + "\n", *many[:150])
    file("several", "\n".join(json.dumps(r, indent=1) for r in many[:20]), *many[:20])
    file("envelope", json.dumps({"meta": {"a": [{"x": 1}], "b": [[{}]]}, "note": 'x "events": [{', "other": [{"y": 2}], "events": many, "more": [{"z": 3}, {}], "end": 5}), *many)
    file("only", json.dumps({"things": many[:90]}, indent=3), *many[:90])
    file("mixed", json.dumps({"items": [1, "x}", {"a": 1}, [2, {"b": 2}], {"c": 3}, "tail]"]}), 1, "x}", {"a": 1}, [2, {"b": 2}], {"c": 3}, "tail]")
    file("unnamed", json.dumps(one := {"p": [{"a": 1}, {"b": 2}], "q": [{"c": 3}], "s": 1}), one)
    file("object", json.dumps(alone := {"message": "alone", "inner": {"x": {"y": 1}}}), alone)
    file("scalars", json.dumps([1, 2]), 1, 2)
    file("nested", json.dumps([[{"a": 1}], {"b": 2}, [3]]), [{"a": 1}], {"b": 2}, [3])
    for name, text in (("empty", ""), ("blank", " \n"), ("nothing", "[]"), ("no_elements", '{"events": []}'), ("text", "no json here }{")):
        file(name, text)

    def shown(df):
        out = []
        for r in df.collect():
            try:
                out.append(json.dumps(json.loads(r.object), sort_keys=True))
            except ValueError:
                out.append(json.dumps(r.object))
        return sorted(out)

    got = shown(jsonlogs.read_objects(spark, str(tmp_path / "*.json")))
    assert got == sorted(expected)
    pieces = jsonsplit.fragments(spark, str(tmp_path / "array.json"))
    size = (tmp_path / "array.json").stat().st_size
    assert pieces.select("_block").distinct().count() == -(-size // 3000) > 1  # one array, a task per split
    assert jsonlogs.read_json_logs(spark, str(tmp_path / "array.json")).where("message rlike '^m[0-9]+$'").count() == 400


def test_strings_over_borders(spark, tmp_path, small_splits):
    """Braces, quotes and backslashes in long strings, at any place relative to the split."""
    rows = [{"n": i, "s": '}"{\\' * (i % 700), "t": "\\" * (i % 5)} for i in range(0, 1400, 13)]
    (tmp_path / "a.json").write_text(json.dumps({"Records": rows}))
    assert found(jsonlogs.read_objects(spark, str(tmp_path))) == sorted(json.dumps(r, sort_keys=True) for r in rows)


def test_lists_of():
    assert jsonsplit.lists_of('{"a": {"b": [1]}, "c": [1, {"d": [2]}], "e\\"": [', False) == ([("c", '1, {"d": [2]}'), ('e"', "")], 3)
    assert jsonsplit.lists_of(', 5 ], "k": 1, "l": [{"x": 1}', True) == ([(None, ", 5 "), ("l", '{"x": 1}')], 2)


def test_cloudtrail_envelope_by_split(spark, tmp_path, small_splits):
    record = {"eventTime": "2024-01-01T00:00:00Z", "eventName": "StopLogging", "eventSource": "x", "userIdentity": {"arn": "arn:aws:sts::1:role/eve", "x": [{"y": "}"}]}, "requestParameters": {"a": [{"b": 1}]}}
    (tmp_path / "a.json").write_text(json.dumps({"Records": [{**record, "eventID": str(i)} for i in range(300)]}))
    (tmp_path / "b.json").write_text(json.dumps(record))
    rows = cloud.read_cloudtrail(spark, str(tmp_path)).collect()
    assert len(rows) == 301 and {r.user for r in rows} == {"eve"}

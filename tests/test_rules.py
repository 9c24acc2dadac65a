"""Rule compilation."""

import json

import pytest
from conftest import at
from pyspark.sql import functions as F

from logsieve.operators import rules as custom
from logsieve.operators import sigma, signatures


def test_script_rule(spark):
    rows = [(4104, "Invoke-WebRequest -Uri http://x"), (4104, "Get-Date"), (4625, "DownloadString")]
    df = spark.createDataFrame(rows, "EventID int, ScriptBlockText string").withColumn("entry_id", F.monotonically_increasing_id())
    rule = sigma.SigmaRule("r", "Script", {"selection": {"EventID": 4104, "ScriptBlockText|contains": ["invoke-webrequest", "DownloadString"]}, "condition": "selection"})
    assert sigma.sigma_match(df, [rule]).count() == 1


@pytest.mark.parametrize(
    "selection,expected",
    [({"a": "ab*"}, ["abc"]), ({"a": "a?c"}, ["abc"]), ({"a": "ABC"}, ["abc"]), ({"a": ["abc", "x.y"]}, ["abc", "x.y"]), ({"a|re": "^x[.]"}, ["x.y"]),
     ({"a": None}, []), ({"zz": "abc"}, []), ([{"a": "abc"}, {"a|startswith": "X"}], ["abc", "x.y"]), ({"a|contains|all": ["b", "c"]}, ["abc"])],
)
def test_field_tests(spark, selection, expected):
    df = spark.createDataFrame([("abc",), ("x.y",), (None,)], "a string").withColumn("entry_id", F.col("a"))
    rule = sigma.SigmaRule("r", "t", {"selection": selection, "condition": "selection"})
    assert sorted(r.entry_id for r in sigma.sigma_match(df, [rule]).collect() if r.entry_id) == expected


@pytest.mark.parametrize(
    "condition,expected",
    [("sel_a and not sel_b", "(`A` and `B`)"), ("1 of sel_*", None), ("all of them", None)],
)
def test_conditions(spark, condition, expected):
    df = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "id int, p boolean, q boolean")
    names = {"sel_a": "p", "sel_b": "q"}
    got = [r.id for r in df.where(sigma.condition_sql(condition, names)).collect()]
    assert got == {"sel_a and not sel_b": [1], "1 of sel_*": [1, 2], "all of them": [2]}[condition]


def test_aggregate_with_time_frame(spark):
    rows = [(i, "u", at(i * 10)) for i in range(4)] + [(9, "u", at(7200))]
    df = spark.createDataFrame(rows, "entry_id int, user string, ts timestamp").withColumn("level", F.lit("error"))
    rule = sigma.SigmaRule("r", "t", {"selection": {"level": "error"}, "timeframe": "1h", "condition": "selection | count() by user > 3"})
    assert sorted(r.entry_id for r in sigma.sigma_match(df, [rule]).collect()) == [0, 1, 2, 3]


def test_many_rules_are_split_into_passes(spark):
    df = spark.createDataFrame([("a", 1)], "message string, entry_id int")
    rules = [sigma.SigmaRule(str(i), "t", {"selection": {"message": "a"}, "condition": "selection"}) for i in range(120)]
    assert sigma.sigma_match(df, rules).count() == 120


def test_reading_rules(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"title": "t", "id": "1", "detection": {"selection": {"a": 1}, "condition": "selection"}, "tags": ["attack.t1059"]}]))
    (rule,) = sigma.read_rules(str(path))
    assert rule.id == "1" and sigma.attack_id(rule.tags) == "T1059"


def test_unknown_custom_operator_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "a string")
    with pytest.raises(ValueError):
        custom.test({"operator": "xor", "conditions": []} | {"conditions": [{"field": "a", "operator": "exists"}]}, custom.Fields(df))


def test_registered_extractor_and_action(spark):
    df = spark.createDataFrame([("Alpha",), ("b",)], "name string")
    custom.register_extractor("name_length", lambda d: F.length("name"))
    custom.register_action("count_rows", lambda matches, rule, action: matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")))
    try:
        rule = custom.CustomRule("r", "long", {"field": "name_length", "operator": "greater_than", "value": 3})
        matches = custom.custom_match(df, [rule])
        assert [r.name for r in matches.collect()] == ["Alpha"]
        assert custom.run_action(matches, rule, {"action": "count_rows"}, []).first().n == 1
    finally:
        custom.EXTRACTORS.clear()
        custom.ACTION_HANDLERS.clear()


def test_signature_of_any_string(spark):
    df = spark.createDataFrame([(1, "this is malicious"), (2, "Hello"), (3, "hello")], "entry_id int, message string")
    rule = signatures.SignatureRule("test", {"a": signatures.Pattern("malicious"), "b": signatures.Pattern("Hello")})
    assert sorted(r.entry_id for r in signatures.signature_match(df, [rule]).collect()) == [1, 2]

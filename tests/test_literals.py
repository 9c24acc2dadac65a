"""The index of rule strings against the columns that search each string, over odd texts and random rules."""

import random
import re

import pytest

from logsieve.operators import literals, signatures
from logsieve.operators.signatures import Pattern, SignatureRule

CONDITIONS = ("any of them", "all of them", "2 of them", "not $s0", "$s0 AND not ($s1 or $s2)", "any of ($s*) and not all of ($s0, $s1)", "0 of them", "3 of ($t*)", "$s0 or 2 of ($s1, $s2)", "true")


def texts(seed):
    rng = random.Random(seed)
    words = ["Login", "user_7", "POWERSHELL", "straße", "Σίσυφος", "İstanbul", "日本語テキスト", "Kelvin", "a.b", "x\ny", "😀 emoji", "tail"]
    rows = [None, "", "abc", "abcd", "İ" * 9 + "abcd", "ΑΣ ΑΣΒ"] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    long = " ".join(rng.choices(words, k=9000))
    border = "y" * (literals.PIECE - 3) + "straddle the border" + "z" * 50
    return [*rows, long, border, border.upper(), long]


def some_rules(seed, n, rows):
    rng = random.Random(seed)
    rules = []
    for i in range(n):
        strings = {}
        for j in range(3):
            t = rng.choice([r for r in rows if r])
            a = rng.randrange(len(t))
            literal = t[a : a + rng.choice([1, 3, 4, 5, 8, 12, 40])]
            if rng.random() < 0.2:
                literal += "#"
            nocase = rng.random() < 0.5
            regex = rng.random() < 0.15
            strings[f"s{j}"] = Pattern(re.escape(literal) if regex else literal.swapcase() if nocase else literal, nocase, regex)
        strings["s2"] = strings["s0"] if i % 9 == 0 else strings["s2"]
        rules.append(SignatureRule(f"r{i}", strings, CONDITIONS[i % len(CONDITIONS)], "low", "c", "T1", [(), ("APT",), ("experimental", "APT", "other")][i % 3]))
    return rules


def as_rows(df):
    return sorted((r.entry_id is None, r.entry_id or 0, r.rule, r.severity, r.category, r.mitre_technique, round(r.confidence, 6), tuple(r.strings)) for r in df.collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_index_equals_columns(spark, monkeypatch, broadcast):
    rows = texts(1)
    rules = some_rules(2, 60, rows)
    df = spark.createDataFrame([(None if i % 11 == 0 else i, t) for i, t in enumerate(rows)] + [(5, rows[30])], "entry_id long, message string")
    expected = as_rows(signatures._one_pass(df, rules, "message", ["entry_id"]))
    if not broadcast:
        monkeypatch.setattr(literals, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(literals, "DIRECT_PATTERNS", 7)
    got = as_rows(signatures.signature_match(df, rules))
    assert got == expected and len(expected) > 500
    assert signatures.signature_match(df.where("entry_id < 0"), rules).count() == 0


def test_conditions():
    names = ["a1", "a2", "b"]

    def holds(condition, found):
        c = literals.condition_of(condition, names)
        met = {g for g, (ids, least) in enumerate(c.groups) if len(set(ids) & found) >= least}
        return any(a <= met and not b & met for a, b in c.alternatives)

    cases = [set(), {"a1"}, {"a2"}, {"b"}, {"a1", "a2"}, {"a1", "b"}, {"a1", "a2", "b"}]
    for condition, plain in (
        ("any of ($a*)", lambda f: bool(f & {"a1", "a2"})),
        ("all of ($a*) or $b", lambda f: {"a1", "a2"} <= f or "b" in f),
        ("not ($a1 and not $b)", lambda f: not ("a1" in f and "b" not in f)),
        ("2 of them and not all of them", lambda f: len(f) == 2),
        ("any of ($zz*)", lambda f: False),
        ("NOT any of ($zz*) AND $b", lambda f: "b" in f),
        ("$b and not $b", lambda f: False),
    ):
        assert [holds(condition, f) for f in cases] == [plain(f) for f in cases], condition
    many = " and ".join(f"($s{2 * i} or $s{2 * i + 1})" for i in range(30))
    assert literals.condition_of(many, [f"s{i}" for i in range(60)]) is None
    assert literals.condition_of("not $b", names).holds_without_strings


def test_one_pass_for_thousands_of_rules(spark):
    """5,000 rules are one index: the number of columns and of scans of the text doesn't grow with them."""
    rules = [SignatureRule(f"r{i}", {"a": Pattern(f"needle-{i}-x"), "b": Pattern(f"PIN {i};", True)}, "$a and $b") for i in range(5000)]
    df = spark.createDataFrame([(i, f"line with needle-{i}-x and pin {i if i % 2 else i + 1}; end") for i in range(0, 6000, 7)], "entry_id long, message string")
    found = signatures.signature_match(df, rules)
    assert {r.entry_id for r in found.collect()} == {i for i in range(0, 5000, 7) if i % 2}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 40_000 and plan.count("rlike") == 0

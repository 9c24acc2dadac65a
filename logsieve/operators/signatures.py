"""Signature rules: sets of strings searched in text, combined by a condition."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.operators import literals

# fixed values: rules that are always critical
ALWAYS_CRITICAL = ("Ransomware_FileExtensions", "Webshell_Indicators", "Credential_Dumping")
SHOWN_CHARACTERS = 200
RULES_PER_PASS = 50


@dataclass(frozen=True)
class Pattern:
    text: str
    nocase: bool = False
    regex: bool = False


@dataclass(frozen=True)
class SignatureRule:
    """`condition` speaks of `$name`, `any of ($group*)`, `all of ($group*)`, `N of ($group*)`, `them`, and/or/not."""

    name: str
    strings: Mapping[str, Pattern]
    condition: str = "any of them"
    severity: str = "medium"
    category: str = "unknown"
    mitre: str = ""
    tags: Sequence[str] = field(default_factory=tuple)


def _found(text: Column, lowered: Column, pattern: Pattern) -> Column:
    if pattern.regex:
        return text.rlike(f"(?i){pattern.text}" if pattern.nocase else pattern.text)
    if pattern.nocase:
        return lowered.contains(pattern.text.lower())
    return text.contains(pattern.text)


def _condition_sql(condition: str, names: Mapping[str, str]) -> str:
    def members(listed: str) -> list[str]:
        wanted = [w.strip() for w in listed.strip("() ").split(",")]
        regexes = [re.compile("^" + re.escape(w).replace(r"\*", ".*") + "$") for w in wanted]
        return [f"`{c}`" for n, c in names.items() if any(r.match("$" + n) for r in regexes)]

    def group(match: re.Match) -> str:
        how, listed = match.group(1).lower(), match.group(2)
        columns = [f"`{c}`" for c in names.values()] if listed == "them" else members(listed)
        if not columns:
            return "false"
        if how == "any":
            return "(" + " or ".join(columns) + ")"
        if how == "all":
            return "(" + " and ".join(columns) + ")"
        return "(" + " + ".join(f"cast({c} as int)" for c in columns) + f" >= {int(how)})"

    spelled = re.sub(r"\b(any|all|\d+)\s+of\s+(them|\([^)]*\))", group, condition)
    return re.sub(r"\$(\w+)", lambda m: f"`{names[m.group(1)]}`", spelled)


def confidence(n_strings: Column, tags: Sequence[str]) -> Column:
    base = 0.8 + (0.1 if "APT" in tags else 0.0) - (0.2 if "experimental" in tags else 0.0)
    lift = F.when(n_strings > 10, 0.15).when(n_strings > 5, 0.1).otherwise(0.0)
    return F.least(F.lit(base) + lift, F.lit(1.0))


def signature_match(
    df: DataFrame, rules: Sequence[SignatureRule], text: str = "message", keep: Sequence[str] = ("entry_id",)
) -> DataFrame:
    """One row per rule and text it matches, with the matched strings; each text is searched once.

    Up to RULES_PER_PASS rules are columns over the text. More are matched through an index of their strings (`literals`),
    with the same rows; only rules that hold without any string, or whose condition has very many alternatives, stay
    columns, RULES_PER_PASS at a time.
    """
    few, many, conditions = list(rules), [], []
    if len(few) > RULES_PER_PASS:
        found = [(r, literals.condition_of(r.condition, list(r.strings))) for r in rules]
        few = [r for r, c in found if c is None or c.holds_without_strings]
        many, conditions = zip(*[(r, c) for r, c in found if c is not None and not c.holds_without_strings], strict=True) if len(few) < len(found) else ([], [])
    parts = [_one_pass(df, few[i : i + RULES_PER_PASS], text, keep) for i in range(0, len(few), RULES_PER_PASS)]
    if many:
        parts.append(literals.indexed_match(df, many, conditions, text, keep, SHOWN_CHARACTERS, _severity, confidence))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _severity(rule: SignatureRule) -> str:
    return "critical" if rule.name in ALWAYS_CRITICAL else rule.severity


def _one_pass(df, rules, text, keep) -> DataFrame:
    source = df.select(*keep, F.col(text).alias("_text"), F.lower(text).alias("_lowered"))
    # a string that several rules share is searched for once
    shared: dict[Pattern, str] = {}
    for rule in rules:
        for pattern in rule.strings.values():
            shared.setdefault(pattern, f"_p{len(shared)}")
    flags = source.select(
        *keep, *[F.coalesce(_found(F.col("_text"), F.col("_lowered"), p), F.lit(False)).alias(c) for p, c in shared.items()]
    )
    hits = []
    for rule in rules:
        names = {n: shared[p] for n, p in rule.strings.items()}
        strings = F.array_compact(
            F.array(*[F.when(F.col(shared[p]), F.lit(p.text[:SHOWN_CHARACTERS])) for p in rule.strings.values()])
        )
        hits.append(
            F.when(
                F.expr(_condition_sql(rule.condition, names)),
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(_severity(rule)).alias("severity"),
                    F.lit(rule.category).alias("category"),
                    F.lit(rule.mitre).alias("mitre_technique"),
                    confidence(F.size(strings), rule.tags).alias("confidence"),
                    strings.alias("strings"),
                ),
            )
        )
    found = explode_computed(flags, keep, F.array_compact(F.array(*hits)), "_hit")
    return found.select(*keep, "_hit.*")


def signatures_table(spark: SparkSession, rules: Sequence[SignatureRule]) -> DataFrame:
    rows = [
        (r.name, r.severity, r.category, r.mitre, n, re.sub(r"\d+$", "", n), p.text, p.nocase)
        for r in rules
        for n, p in r.strings.items()
    ]
    schema = "rule string, severity string, category string, mitre string, string_id string, string_group string, pattern string, nocase boolean"
    return spark.createDataFrame(rows, schema)

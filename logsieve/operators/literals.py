"""Large sets of signature rules in one pass over the text: an index of the strings by their rarest n-gram.

Every string is kept under one of its runs of GRAM characters, the one that is rarest in a sample of the texts. A text gives
its distinct runs, which meet the index in an equijoin, and each string that is met is looked for once in the text. So the work
per text grows with its length and with the strings that are likely in it, not with the number of rules. Strings found are
then gathered per text and rule, and the rules' conditions are evaluated as data: alternatives of groups of strings that are
found, or not found, in sufficient number.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed

GRAM = 4
PIECE = 1 << 14  # long texts are cut into pieces of so many characters, which overlap by the longest string
SAMPLE_ROWS = 10_000  # of the texts, to tell rare runs from frequent ones; decides the work, never the result
BROADCAST_ROWS = 200_000  # an index of up to so many strings is sent to all tasks, a larger one is joined by shuffle
MOST_ALTERNATIVES = 64  # a condition with more is not evaluated as data
DIRECT_PATTERNS = 200  # expressions, and strings without a usable run, that are tested in one projection


@dataclass(frozen=True)
class Condition:
    """A rule's condition as alternatives of (groups that must be met, groups that must not); groups: (string ids, least number)."""

    groups: tuple[tuple[tuple[str, ...], int], ...]
    alternatives: tuple[tuple[frozenset[int], frozenset[int]], ...]

    @property
    def holds_without_strings(self) -> bool:
        return any(not met for met, _ in self.alternatives)


def _members(listed: str, names: Sequence[str]) -> tuple[str, ...]:
    if listed == "them":
        return tuple(names)
    wanted = [re.compile("^" + re.escape(w.strip()).replace(r"\*", ".*") + "$") for w in listed.strip("() ").split(",")]
    return tuple(n for n in names if any(r.match("$" + n) for r in wanted))


def condition_of(text: str, names: Sequence[str]) -> Condition | None:
    """The condition over these string ids; None where it has too many alternatives."""
    groups: list[tuple[tuple[str, ...], int]] = []

    def named(members: tuple[str, ...], least: int) -> str:
        if not members:
            return "False"
        if least <= 0:
            return "True"
        if (members, least) not in groups:
            groups.append((members, least))
        return f"g{groups.index((members, least))}"

    def counted(match: re.Match) -> str:
        members = _members(match.group(2), names)
        how = match.group(1).lower()
        return named(members, 1 if how == "any" else len(members) if how == "all" else int(how))

    spelled = re.sub(r"\b(any|all|\d+)\s+of\s+(them|\([^)]*\))", counted, text)
    spelled = re.sub(r"\$(\w+)", lambda m: named((m.group(1),), 1), spelled)
    for word, plain in (("and", "and"), ("or", "or"), ("not", "not"), ("true", "True"), ("false", "False")):
        spelled = re.sub(rf"\b{word}\b", plain, spelled, flags=re.IGNORECASE)

    def alternatives(node: ast.expr, wanted: bool) -> list[tuple[frozenset[int], frozenset[int]]]:
        if isinstance(node, ast.UnaryOp):
            return alternatives(node.operand, not wanted)
        if isinstance(node, ast.Constant):
            return [(frozenset(), frozenset())] if bool(node.value) == wanted else []
        if isinstance(node, ast.Name):
            group = frozenset([int(node.id[1:])])
            return [(group, frozenset())] if wanted else [(frozenset(), group)]
        parts = [alternatives(v, wanted) for v in node.values]
        if isinstance(node.op, ast.Or) == wanted:
            out = [a for part in parts for a in part]
        else:
            out = [(frozenset(), frozenset())]
            for part in parts:
                out = [(a | c, b | d) for a, b in out for c, d in part]
                if len(out) > MOST_ALTERNATIVES**2:
                    raise OverflowError
        return [(a, b) for a, b in dict.fromkeys(out) if not a & b]

    try:
        found = alternatives(ast.parse(spelled.strip(), mode="eval").body, True)
    except OverflowError:
        return None
    return Condition(tuple(groups), tuple(found)) if len(found) <= MOST_ALTERNATIVES else None


def usable_runs(text: str, nocase: bool) -> list[str]:
    """The runs of GRAM characters, in lower case, that every text with this string has when it is lowered.

    Single ASCII letters are lowered alike wherever they stand; other letters are only if the whole text is searched in lower
    case, and a sigma depends on what follows it.
    """
    lowered = text.lower() if nocase else text
    runs = [lowered[i : i + GRAM] for i in range(len(lowered) - GRAM + 1)]
    return [] if nocase and set(lowered) & set("σς") else [r.lower() for r in runs if nocase or r.isascii()]


def runs_of(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text, lowered."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def pieces_of(text: Column, overlap: int) -> Column:
    """The text in pieces, each with the first `overlap` characters of what follows; a short text is one piece."""
    size = max(PIECE, overlap)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    joined = F.transform(cut, lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, overlap)))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(joined)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def rarest_runs(texts: DataFrame, runs: Mapping[int, Sequence[str]], sample_rows: int) -> dict[int, str]:
    """For each string the run that the fewest sampled texts hold, of equal ones the first in order."""
    spark = texts.sparkSession
    wanted = sorted({r for options in runs.values() for r in options})
    if not wanted:
        return {}
    sample = explode_computed(texts.limit(sample_rows), [], runs_of(F.col("text")), "run")
    table = spark.createDataFrame([(r,) for r in wanted], "run string")
    seen = {r["run"]: r["count"] for r in sample.join(_small(table, len(wanted)), "run").groupBy("run").count().collect()}
    return {k: min(options, key=lambda r: (seen.get(r, 0), r)) for k, options in runs.items()}


def strings_found(df: DataFrame, strings: Sequence[tuple[str, bool, bool]], text: str, keep: Sequence[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(row, kept columns, string): which of the strings (text, nocase, is an expression) each text holds, once each.

    row numbers the rows of df within the job. Null texts hold nothing.
    """
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("_text")).where(F.col("_text").isNotNull())
    runs = {k: usable_runs(s, nocase) for k, (s, nocase, regex) in enumerate(strings) if not regex}
    runs = {k: options for k, options in runs.items() if options}
    keys = rarest_runs(df.select(F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull()), runs, sample_rows)
    named = ["_row", *(f"`{c}`" for c in keep)]
    found = []
    if keys:
        index = spark.createDataFrame(
            [(r, k, strings[k][0].lower() if strings[k][1] else strings[k][0], strings[k][1]) for k, r in keys.items()], "_run string, _string int, _needle string, _nocase boolean"
        )
        overlap = max(len(strings[k][0].lower()) for k in keys) - 1
        pieces = explode_computed(rows, named, pieces_of(F.col("_text"), overlap), "_piece")
        met = explode_computed(pieces, [*named, "_piece"], runs_of(F.col("_piece")), "_run").join(_small(index, len(keys)), "_run")
        holds = F.when(F.col("_nocase"), F.lower("_piece").contains(F.col("_needle"))).otherwise(F.col("_piece").contains(F.col("_needle")))
        found.append(met.where(holds).select(*named, "_string"))
    direct = [k for k in range(len(strings)) if k not in keys]
    for first in range(0, len(direct), DIRECT_PATTERNS):
        tests = []
        for k in direct[first : first + DIRECT_PATTERNS]:
            needle, nocase, regex = strings[k]
            if regex:
                test = F.col("_text").rlike(f"(?i){needle}" if nocase else needle)
            else:
                test = F.lower("_text").contains(needle.lower()) if nocase else F.col("_text").contains(needle)
            tests.append(F.when(test, F.lit(k)))
        found.append(explode_computed(rows, named, F.array_compact(F.array(*tests)), "_string"))
    if not found:
        return rows.select(*named, F.lit(0).alias("_string")).where(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def indexed_match(df: DataFrame, rules: Sequence, conditions: Sequence[Condition], text: str, keep: Sequence[str], shown_characters: int, levels, confidence) -> DataFrame:
    """Matches of rules whose conditions need a string: row, kept columns, rule, severity, category, mitre, confidence and strings.

    levels(rule) gives its severity; confidence(number of strings, tags) its confidence.
    """
    spark = df.sparkSession
    patterns: dict[tuple[str, bool, bool], int] = {}
    members, table = [], []
    for number, (rule, condition) in enumerate(zip(rules, conditions, strict=True)):
        for place, (name, p) in enumerate(rule.strings.items()):
            key = patterns.setdefault((p.text, p.nocase, p.regex), len(patterns))
            members.append((key, number, place, p.text[:shown_characters], [g for g, (ids, _) in enumerate(condition.groups) if name in ids]))
        alternatives = [(sorted(met), sorted(unmet)) for met, unmet in condition.alternatives]
        tags = [t for t in rule.tags if t in ("APT", "experimental")]
        table.append((number, rule.name, levels(rule), rule.category, rule.mitre, tags, [least for _, least in condition.groups], alternatives))
    strings = spark.createDataFrame(members, "_string int, _rule int, place int, shown string, groups array<int>")
    meta = spark.createDataFrame(
        table,
        "_rule int, rule string, severity string, category string, mitre_technique string, _tags array<string>, _least array<int>, _alternatives array<struct<met: array<int>, unmet: array<int>>>",
    )
    named = ["_row", *(f"`{c}`" for c in keep)]
    hits = strings_found(df, list(patterns), text, keep).join(_small(strings, len(members)), "_string")
    per_rule = hits.groupBy(*named, "_rule").agg(F.array_sort(F.collect_set(F.struct("place", "shown", "groups"))).alias("_found")).join(_small(meta, len(table)), "_rule")
    enough = F.filter(
        F.sequence(F.lit(0), F.size("_least") - 1), lambda g: F.size(F.filter("_found", lambda s: F.array_contains(s["groups"], g))) >= F.get("_least", g)
    )
    per_rule = per_rule.withColumn("_met", enough)
    fires = F.exists("_alternatives", lambda a: (F.size(F.array_except(a["met"], F.col("_met"))) == 0) & ~F.arrays_overlap(a["unmet"], F.col("_met")))
    strings_shown = F.transform("_found", lambda s: s["shown"])
    sure = F.lit(None).cast("double")
    for tags in ((), ("APT",), ("experimental",), ("APT", "experimental")):
        same = (F.array_contains("_tags", "APT") == F.lit("APT" in tags)) & (F.array_contains("_tags", "experimental") == F.lit("experimental" in tags))
        sure = F.when(same, confidence(F.size("_found"), tags)).otherwise(sure)
    return per_rule.where(fires).select(
        *(f"`{c}`" for c in keep), "rule", "severity", "category", "mitre_technique", sure.alias("confidence"), strings_shown.alias("strings")
    )

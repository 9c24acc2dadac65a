"""Sigma-style detection rules as Columns, all rules in one pass over the data.

A rule's selections become boolean columns and its condition becomes a Spark SQL
expression over them, so precedence, brackets and `not` are Spark's own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed

RULES_PER_PASS = 50
CONFIDENCE = {"simple": 0.9, "complex": 0.8, "aggregate": 0.85}

# fixed values: product, category, service of each log type
LOG_SOURCES = {
    "syslog": ("linux", "syslog", "*"),
    "windows_event": ("windows", "*", "*"),
    "apache": ("*", "webserver", "apache"),
    "nginx": ("*", "webserver", "nginx"),
    "firewall": ("*", "firewall", "*"),
    "aws_cloudtrail": ("aws", "cloudtrail", "*"),
    "pcap": ("*", "network", "*"),
    "netflow": ("*", "netflow", "*"),
}
WINDOWS_CHANNELS = {"Security": "security", "System": "system"}


@dataclass(frozen=True)
class SigmaRule:
    id: str
    title: str
    detection: Mapping[str, Any]
    level: str = "medium"
    tags: Sequence[str] = ()
    logsource: Mapping[str, str] = field(default_factory=dict)

    @property
    def condition(self) -> str:
        return str(self.detection.get("condition", "selection")).strip()

    @property
    def selections(self) -> dict[str, Any]:
        return {k: v for k, v in self.detection.items() if k not in ("condition", "timeframe")}

    @property
    def is_aggregate(self) -> bool:
        return "|" in self.condition or re.match(r"^(count|sum|avg|min|max)\(", self.condition) is not None


def read_rules(path: str) -> list[SigmaRule]:
    """Rules from a JSON or multi-document YAML file."""
    source = Path(path)
    if source.suffix == ".json":
        loaded = json.loads(source.read_text())
        documents = loaded if isinstance(loaded, list) else [loaded]
    else:
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover
            raise RuntimeError("reading YAML rules needs the yaml package; use JSON instead") from exc
        documents = [d for d in yaml.safe_load_all(source.read_text()) if d]
    return [
        SigmaRule(
            id=str(d.get("id", d["title"])),
            title=d["title"],
            detection=d["detection"],
            level=d.get("level", "medium"),
            tags=tuple(d.get("tags", ())),
            logsource=d.get("logsource", {}),
        )
        for d in documents
        if isinstance(d.get("detection"), dict)
    ]


def applicable_rules(
    rules: Sequence[SigmaRule], log_type: str, event_id: bool = False, channel: str | None = None
) -> list[SigmaRule]:
    """Rules whose log source fits that of the data; absent parts of a rule's source are wildcards."""
    product, category, service = LOG_SOURCES.get(log_type, ("*", "*", "*"))
    if event_id:
        product, service = "windows", WINDOWS_CHANNELS.get(channel or "", service)
    wanted = {
        (product, category, service), (product, category, "*"), (product, "*", service), (product, "*", "*"),
        ("*", category, "*"), ("*", "*", service),
    }
    keys = lambda r: tuple(str(r.logsource.get(k, "*")) for k in ("product", "category", "service"))
    return [r for r in rules if keys(r) in wanted]


class FieldAccess:
    """Rule field names to Columns: a column of that name, a mapped column, or a key of a map column."""

    def __init__(self, df: DataFrame, mapping: Mapping[str, str] | None = None, attrs: str | None = None):
        self.columns = set(df.columns)
        self.mapping = dict(mapping or {})
        self.attrs = attrs

    def __call__(self, name: str) -> Column:
        name = self.mapping.get(name, name)
        if name in self.columns:
            return F.col(f"`{name}`")
        if "." in name and name.split(".", 1)[0] in self.columns:
            return F.col(name)
        if self.attrs is not None:
            return F.try_element_at(F.col(self.attrs), F.lit(name))
        return F.lit(None).cast("string")


def _wildcard(pattern: str) -> str:
    out = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return f"(?s)^{out}$"


def field_test(actual: Column, expected: Any, modifiers: Sequence[str]) -> Column:
    """One field against one value or a list of values; case does not matter."""
    if isinstance(expected, list):
        tests = [field_test(actual, e, [m for m in modifiers if m != "all"]) for e in expected]
        return reduce(lambda a, b: a & b if "all" in modifiers else a | b, tests)
    if isinstance(expected, dict):
        bounds = []
        number = actual.cast("string").try_cast("double")
        if "min" in expected:
            bounds.append(number >= float(expected["min"]))
        if "max" in expected:
            bounds.append(number <= float(expected["max"]))
        return reduce(lambda a, b: a & b, bounds)
    if expected is None:
        return actual.isNull()
    shown = str(expected).lower()
    text = F.lower(actual.cast("string"))
    number = actual.cast("string").try_cast("double")
    kind = next((m for m in modifiers if m != "all"), None)
    if kind == "contains":
        return text.contains(shown)
    if kind == "startswith":
        return text.startswith(shown)
    if kind == "endswith":
        return text.endswith(shown)
    if kind in ("re", "regex"):
        return actual.cast("string").rlike(f"(?i){expected}")
    if kind in ("gt", "gte", "lt", "lte"):
        bound = float(expected)
        return {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[kind]
    compared = re.match(r"^(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)$", shown)
    if compared:
        sign, bound = compared.group(1), float(compared.group(2))
        return {">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound}[sign]
    if "*" in shown or "?" in shown:
        return text.rlike(_wildcard(shown))
    return text == shown


def selection_test(selection: Any, fields: FieldAccess) -> Column:
    """A map is an AND over its fields, a list an OR over its parts; a missing field fails."""
    if isinstance(selection, list):
        return reduce(lambda a, b: a | b, [selection_test(s, fields) for s in selection])
    if not isinstance(selection, dict):
        return field_test(fields("message"), selection, ["contains"])
    tests = []
    for key, expected in selection.items():
        name, *modifiers = str(key).split("|")
        tests.append(F.coalesce(field_test(fields(name), expected, modifiers), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def condition_sql(condition: str, names: Mapping[str, str]) -> str:
    """The condition with each selection name replaced by its column, `1 of`/`all of` spelled out."""

    def group(match: re.Match) -> str:
        how, pattern = match.group(1).lower(), match.group(2)
        regex = re.compile("^.*$" if pattern == "them" else "^" + re.escape(pattern).replace(r"\*", ".*") + "$")
        members = [f"`{column}`" for name, column in names.items() if regex.match(name)]
        if not members:
            return "false"
        if how in ("all", "1", "any"):
            return "(" + (" and " if how == "all" else " or ").join(members) + ")"
        return "(" + " + ".join(f"cast({m} as int)" for m in members) + f" >= {int(how)})"

    spelled = re.sub(r"\b(all|any|\d+)\s+of\s+([\w*]+)", group, condition, flags=re.IGNORECASE)
    parts = re.split(r"(`[^`]*`)", spelled)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\b[A-Za-z_]\w*\b", lambda m: f"`{names[m.group(0)]}`" if m.group(0) in names else m.group(0), parts[i])
    return "".join(parts)


def attack_id(tags: Sequence[str]) -> str:
    return next((t.replace("attack.", "").upper() for t in tags if t.startswith("attack.t")), "")


def rules_table(spark: SparkSession, rules: Sequence[SigmaRule]) -> DataFrame:
    """The catalogue: one row per rule."""
    rows = [
        (
            r.id, r.title, r.level, list(r.tags), attack_id(r.tags), str(r.logsource.get("product", "*")),
            str(r.logsource.get("category", "*")),
        )
        for r in rules
    ]
    schema = "rule_id string, title string, level string, tags array<string>, attack_id string, product string, category string"
    return spark.createDataFrame(rows, schema)


def sigma_match(
    df: DataFrame,
    rules: Sequence[SigmaRule],
    keep: Sequence[str] = ("entry_id",),
    mapping: Mapping[str, str] | None = None,
    attrs: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """One row (rule_id, confidence, kept columns) per rule and row it matches."""
    row_rules = [r for r in rules if not r.is_aggregate]
    parts = [
        _match_rows(df, row_rules[i : i + RULES_PER_PASS], keep, mapping, attrs)
        for i in range(0, len(row_rules), RULES_PER_PASS)
    ]
    parts += [_match_aggregate(df, r, keep, mapping, attrs, ts) for r in rules if r.is_aggregate]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _match_rows(df, rules, keep, mapping, attrs) -> DataFrame:
    fields = FieldAccess(df, mapping, attrs)
    flags, results = {}, []
    for n, rule in enumerate(rules):
        names = {name: f"_r{n}_{i}" for i, name in enumerate(rule.selections)}
        flags.update({names[s]: selection_test(test, fields) for s, test in rule.selections.items()})
        confidence = CONFIDENCE["simple" if rule.condition == "selection" else "complex"]
        hit = F.struct(F.lit(rule.id).alias("rule_id"), F.lit(confidence).alias("confidence"))
        results.append(F.when(F.expr(condition_sql(rule.condition, names)), hit))
    flagged = df.select(*keep, *[c.alias(n) for n, c in flags.items()])
    found = explode_computed(flagged, keep, F.array_compact(F.array(*results)), "_hit")
    return found.select("_hit.rule_id", "_hit.confidence", *keep)


AGGREGATE = re.compile(
    r"^(?:(?P<sel>\w+)\s*\|\s*)?(?P<fn>count|sum|avg|min|max)\(\s*(?P<by1>by\s+)?(?P<field>[\w.]*)\s*\)"
    r"(?:\s+by\s+(?P<by2>[\w.]+))?\s*(?P<op>>=|<=|>|<|=)\s*(?P<value>-?\d+(?:\.\d+)?)$",
    re.IGNORECASE,
)
TIMEFRAME_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def _match_aggregate(df, rule, keep, mapping, attrs, ts) -> DataFrame:
    """`selection | count() by f > n`, per time frame where the rule names one."""
    parsed = AGGREGATE.match(rule.condition)
    if parsed is None:
        raise ValueError(f"rule {rule.id}: cannot read condition {rule.condition!r}")
    fields = FieldAccess(df, mapping, attrs)
    selection = parsed["sel"] or next(iter(rule.selections))
    name, by = parsed["field"], parsed["by2"]
    if parsed["by1"]:
        name, by = "", parsed["field"]
    matched = df.where(selection_test(rule.selections[selection], fields))
    keys = []
    if by:
        matched = matched.withColumn("_by", fields(by).cast("string")).where(F.col("_by").isNotNull())
        keys.append("_by")
    frame = rule.detection.get("timeframe")
    if frame:
        size = f"{frame[:-1]} {TIMEFRAME_UNITS[frame[-1].lower()]}"
        matched = matched.withColumn("_frame", F.window(F.col(ts).cast("timestamp"), size).getField("start"))
        keys.append("_frame")
    number = fields(name).cast("string").try_cast("double") if name else None
    fn = parsed["fn"].lower()
    if fn == "count":
        value = F.count(F.lit(1)) if not name else F.count_distinct(fields(name))
    else:
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](number)
    bound = float(parsed["value"])
    op = parsed["op"]
    totals = matched.groupBy(*keys).agg(value.alias("_v"))
    over = {
        ">": F.col("_v") > bound, ">=": F.col("_v") >= bound, "<": F.col("_v") < bound, "<=": F.col("_v") <= bound,
        "=": F.col("_v") == bound,
    }[op]
    hits = totals.where(over)
    if keys:
        rows = matched.join(hits.select(*keys), keys, "left_semi")
    else:
        rows = matched.where(hits.select(F.count(F.lit(1)) > 0).scalar())
    return rows.select(F.lit(rule.id).alias("rule_id"), F.lit(CONFIDENCE["aggregate"]).alias("confidence"), *keep)


def consolidate(matches: DataFrame, rules: DataFrame, entry: str = "entry_id") -> DataFrame:
    """Per rule: entries matched, highest confidence, attributes of the rule."""
    per_rule = matches.groupBy("rule_id").agg(
        F.count_distinct(entry).alias("match_count"), F.max("confidence").alias("confidence")
    )
    return per_rule.join(rules, "rule_id")


def rule_coverage(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules and matches per level, product, category and technique, including those without a hit."""
    counts = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_hits"))
    all_rules = rules.join(counts, "rule_id", "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    techniques = F.transform(
        F.filter("tags", lambda t: t.startswith("attack.t")), lambda t: F.upper(F.replace(t, F.lit("attack."), F.lit("")))
    )
    facets = F.concat(
        F.array(
            *[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in ("level", "product", "category")]
        ),
        F.transform(techniques, lambda t: F.struct(F.lit("technique").alias("facet"), t.alias("value"))),
    )
    return (
        explode_computed(all_rules, ["rule_id", "_hits"], facets, "_f")
        .groupBy("_f.facet", "_f.value")
        .agg(
            F.count(F.lit(1)).alias("rules"),
            F.count_if(F.col("_hits") > 0).alias("rules_hit"),
            F.sum("_hits").alias("matches"),
        )
    )

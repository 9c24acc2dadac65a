"""Custom rules: field conditions, logic trees and the actions of a match, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import clock, net
from logsieve.functions.rows import explode_computed
from logsieve.functions.text import transform
from logsieve.operators.sigma import FieldAccess


@dataclass(frozen=True)
class CustomRule:
    id: str
    name: str
    condition: Mapping[str, Any]
    severity: str = "medium"
    tags: Sequence[str] = ()
    description: str = ""
    actions: Sequence[Mapping[str, Any]] = ()
    enabled: bool = True
    metadata: Mapping[str, str] = field(default_factory=dict)


# registered by the user: field name -> Column of a DataFrame, action name -> DataFrame of the matches
EXTRACTORS: dict[str, Callable[[DataFrame], Column]] = {}
ACTION_HANDLERS: dict[str, Callable[[DataFrame, CustomRule, Mapping[str, Any]], DataFrame]] = {}


def register_extractor(name: str, build: Callable[[DataFrame], Column]) -> None:
    EXTRACTORS[name] = build


def register_action(name: str, build: Callable[[DataFrame, CustomRule, Mapping[str, Any]], DataFrame]) -> None:
    ACTION_HANDLERS[name] = build


class Fields(FieldAccess):
    """Also knows registered extractors and the size of an event."""

    def __init__(self, df: DataFrame, attrs: str | None = None):
        super().__init__(df, None, attrs)
        self.df = df

    def __call__(self, name: str) -> Column:
        if name in EXTRACTORS:
            return EXTRACTORS[name](self.df)
        if name == "event_size":
            return F.length(F.to_json(F.struct("*")))
        if name == "event_count":
            return F.lit(1)
        return super().__call__(name)


def _fold(col: Column, case_sensitive: bool) -> Column:
    return col.cast("string") if case_sensitive else F.lower(col.cast("string"))


def _fold_value(value: Any, case_sensitive: bool) -> str:
    shown = str(value).lower() if isinstance(value, bool) else str(value)
    return shown if case_sensitive else shown.lower()


def _number(col: Column) -> Column:
    return col.cast("string").try_cast("double")


def _as_list(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _members(col: Column, case_sensitive: bool) -> Column:
    return F.transform(col, lambda v: _fold(v, case_sensitive))


def _literals(value: Any, cs: bool) -> Column:
    return F.array(*[F.lit(_fold_value(v, cs)) for v in _as_list(value)])


# each builder gets (field, rule value, case_sensitive, as_of) and never yields null
OPERATORS: dict[str, Callable[[Column, Any, bool, Column], Column]] = {
    "equals": lambda c, v, cs, _: _fold(c, cs) == _fold_value(v, cs),
    "greater_than": lambda c, v, cs, _: _number(c) > float(v),
    "less_than": lambda c, v, cs, _: _number(c) < float(v),
    "greater_equal": lambda c, v, cs, _: _number(c) >= float(v),
    "less_equal": lambda c, v, cs, _: _number(c) <= float(v),
    "contains": lambda c, v, cs, _: _fold(c, cs).contains(_fold_value(v, cs)),
    "starts_with": lambda c, v, cs, _: _fold(c, cs).startswith(_fold_value(v, cs)),
    "ends_with": lambda c, v, cs, _: _fold(c, cs).endswith(_fold_value(v, cs)),
    "matches": lambda c, v, cs, _: c.cast("string").rlike(v if cs else f"(?i){v}"),
    "in": lambda c, v, cs, _: _fold(c, cs).isin(*[_fold_value(x, cs) for x in _as_list(v)]),
    "any_of": lambda c, v, cs, _: F.arrays_overlap(_members(c, cs), _literals(v, cs)),
    "all_of": lambda c, v, cs, _: F.size(F.array_except(_literals(v, cs), _members(c, cs))) == 0,
    "exists": lambda c, v, cs, _: c.isNotNull(),
    "is_null": lambda c, v, cs, _: c.isNull() | (c.cast("string") == ""),
    "in_cidr": lambda c, v, cs, _: net.in_cidr(c.cast("string"), v),
    "is_private_ip": lambda c, v, cs, _: net.is_private_ip(c.cast("string")),
    "is_public_ip": lambda c, v, cs, _: net.is_public_ip(c.cast("string")),
    "within_last": lambda c, v, cs, now: clock.within_last(c, _seconds(v), now),
    "older_than": lambda c, v, cs, now: clock.older_than(c, _seconds(v), now),
    "between_times": lambda c, v, cs, _: clock.between_times(c, v[0], v[1]),
}
OPPOSITES = {
    "not_equals": "equals", "not_contains": "contains", "not_in": "in", "not_exists": "exists", "is_not_null": "is_null",
}


def _seconds(duration: str) -> int:
    amount, unit = re.match(r"^(\d+)([dhms])$", duration.lower()).groups()
    return int(amount) * clock.DURATION_UNITS[unit]


def test(node: Mapping[str, Any], fields: Callable[[str], Column], as_of: Column | None = None) -> Column:
    """A leaf (has `field`) or a tree node with operator and/or/not and conditions."""
    now = as_of if as_of is not None else F.current_timestamp()
    if "field" in node:
        operator = node["operator"]
        opposite = operator in OPPOSITES
        build = OPERATORS[OPPOSITES.get(operator, operator)]
        hit = build(fields(node["field"]), node.get("value"), bool(node.get("case_sensitive")), now)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if opposite != bool(node.get("negate")) else hit
    parts = [test(child, fields, as_of) for child in node["conditions"]]
    operator = node["operator"].lower()
    if operator == "and":
        return reduce(lambda a, b: a & b, parts)
    if operator == "or":
        return reduce(lambda a, b: a | b, parts)
    if operator == "not":
        return ~reduce(lambda a, b: a & b, parts)
    raise ValueError(f"unknown operator {operator!r}")


def custom_match(
    df: DataFrame, rules: Sequence[CustomRule], as_of: Column | None = None, attrs: str | None = None
) -> DataFrame:
    """Rows of df with `rule_id`, `rule_name`, `rule_severity`, one per rule matched, in one pass."""
    fields = Fields(df, attrs)
    hits = [
        F.when(
            test(r.condition, fields, as_of),
            F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("rule_severity")),
        )
        for r in rules
        if r.enabled
    ]
    found = explode_computed(df, df.columns, F.array_compact(F.array(*hits)), "_hit")
    return found.select(*df.columns, "_hit.rule_id", "_hit.rule_name", "_hit.rule_severity")


def template(pattern: str, fields: Callable[[str], Column]) -> Column:
    """`{field}` places filled from the event; a place whose field is absent stays as written."""
    pieces = []
    for literal, name in re.findall(r"([^{]*)(?:\{([^}]+)\})?", pattern):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(F.coalesce(fields(name).cast("string"), F.lit("{" + name + "}")))
    return F.concat(*pieces) if pieces else F.lit("")


def _of(matches: DataFrame, rule: CustomRule) -> DataFrame:
    return matches.where(F.col("rule_id") == rule.id)


def alerts(matches: DataFrame, rule: CustomRule, action: Mapping[str, Any], keep: Sequence[str]) -> DataFrame:
    own, fields = _of(matches, rule), Fields(matches)
    title = action.get("title_template") or action.get("title", f"Rule '{rule.name}' matched")
    text = action.get("description_template") or action.get("description", rule.description)
    meta = {**rule.metadata, **action.get("metadata", {})}
    pairs = [F.lit(x) for pair in meta.items() for x in pair]
    return own.select(
        *keep,
        "rule_id",
        F.lit(action.get("severity", rule.severity)).alias("severity"),
        (template(title, fields) if "title_template" in action else F.lit(title)).alias("title"),
        (template(text, fields) if "description_template" in action else F.lit(text)).alias("description"),
        F.array(*[F.lit(t) for t in rule.tags]).cast("array<string>").alias("tags"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("metadata"),
    )


def tags(matches: DataFrame, rule: CustomRule, action: Mapping[str, Any], keep: Sequence[str]) -> DataFrame:
    """One row per (event, tag)."""
    own, fields = _of(matches, rule), Fields(matches)
    fixed = [F.lit(t) for t in [*action.get("tags", ()), *rule.tags]]
    made = [template(action["tag_template"], fields)] if "tag_template" in action else []
    return own.select(*keep, F.explode(F.array_distinct(F.array(*fixed, *made))).alias("tag"))


def extracted(matches: DataFrame, rule: CustomRule, action: Mapping[str, Any], keep: Sequence[str]) -> DataFrame:
    own, fields = _of(matches, rule), Fields(matches)
    out = [fields(path).alias(name) for name, path in action.get("fields", {}).items()]
    for name, spec in action.get("regex_extracts", {}).items():
        source = fields(spec.get("field", "message")).cast("string")
        group = 1 if re.compile(spec["pattern"]).groups else 0
        value = F.regexp_extract(source, spec["pattern"], group)
        out.append(F.when(source.rlike(spec["pattern"]), value).alias(name))
    return own.select(*keep, *out)


def enriched(matches: DataFrame, rule: CustomRule, action: Mapping[str, Any]) -> DataFrame:
    """Matches with constant, templated, looked-up and transformed columns added."""
    own, fields = _of(matches, rule), Fields(matches)
    added = {n: F.lit(v) for n, v in action.get("fields", {}).items()}
    for name, how in action.get("computed_fields", {}).items():
        if isinstance(how, str):
            added[name] = template(how, fields)
        elif how["type"] == "lookup":
            added[name] = net.lookup(fields(how["field"]).cast("string"), how["table"], how.get("default"))
        else:
            added[name] = transform(fields(how["field"]), how["transform"])
    return own.withColumns(added)


def enriched_from_table(df: DataFrame, table: DataFrame, on: str, value: str, name: str, default: str | None = None) -> DataFrame:
    """Look-up in a table of any size: a left join, default where nothing is found."""
    known = table.select(F.col(on), F.col(value).alias(name)).dropDuplicates([on])
    out = df.join(known, on, "left")
    return out.withColumn(name, F.coalesce(name, F.lit(default))) if default is not None else out


def aggregated(matches: DataFrame, rule: CustomRule, action: Mapping[str, Any]) -> DataFrame:
    """Count, sum or number of distinct values, per group where one is named."""
    own, fields = _of(matches, rule), Fields(matches)
    kind, name, by = action.get("type", "count"), action.get("field"), action.get("group_by")
    grouped = own.groupBy(fields(by).cast("string").alias("group_value")) if by else own.groupBy(F.lit("all").alias("group_value"))
    if kind == "count":
        value = F.count(F.lit(1)) if not name else F.count(fields(name))
    elif kind == "sum":
        value = F.sum(F.coalesce(_number(fields(name)), F.lit(0.0)))
    else:
        value = F.count_distinct(fields(name))
    return grouped.agg(value.cast("double").alias("value")).select(
        F.lit(rule.id).alias("rule_id"), F.lit(kind).alias("aggregation"), "group_value", "value"
    )


def run_action(matches: DataFrame, rule: CustomRule, action: Mapping[str, Any], keep: Sequence[str]) -> DataFrame:
    """The result of one action; registered handlers come first."""
    kind = action["action"]
    if kind in ACTION_HANDLERS:
        return ACTION_HANDLERS[kind](_of(matches, rule), rule, action)
    if kind == "alert":
        return alerts(matches, rule, action, keep)
    if kind == "tag":
        return tags(matches, rule, action, keep)
    if kind == "extract":
        return extracted(matches, rule, action, keep)
    if kind == "enrich":
        return enriched(matches, rule, action)
    return aggregated(matches, rule, action)


def evaluation_summary(df: DataFrame, rules: Sequence[CustomRule], matches: DataFrame, entry: str) -> DataFrame:
    """One row: events seen, events matched, matches, rules evaluated and rules hit."""
    seen = df.agg(F.count(F.lit(1)).alias("events"))
    found = matches.agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct(entry).alias("events_matched"),
        F.count_distinct("rule_id").alias("rules_hit"),
    )
    from logsieve.operators.stats import with_scalars

    return with_scalars(seen, found).withColumn("rules_evaluated", F.lit(sum(r.enabled for r in rules)))

"""Correlation of events by key and time, by entity, and of findings among each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.functions.text import contains_any
from logsieve.operators.ordered import (
    MICROS, distinct_in_following, neighbour_frames, range_profile, row_index,
)
from logsieve.operators.overlap import connected_components, containment_pairs, distinct_sets

# fixed values: time windows, thresholds and severities of the rules
RULES = {
    "brute_force": {"within": 600, "failures": 5, "confidence": 0.9, "severity": "high"},
    "lateral_movement": {"within": 3600, "targets": 3, "confidence": 0.85, "severity": "critical"},
    "data_exfiltration": {"within": 7200, "confidence": 0.8, "severity": "critical"},
    "c2_communication": {"within": 14400, "events": 5, "cv": 0.2, "severity": "critical"},
    "privilege_escalation": {"within": 1800, "severity": "high"},
    "account_compromise": {"within": 3600, "severity": "high"},
}
ENTITY_FIELDS = (
    "source", "destination", "target", "user", "username", "src_ip", "dst_ip", "domain", "hostname", "process",
    "file", "registry_key", "service",
)
TACTIC_ORDER = (
    "reconnaissance", "resource_development", "initial_access", "execution", "persistence", "privilege_escalation",
    "defense_evasion", "credential_access", "discovery", "lateral_movement", "collection", "command_and_control",
    "exfiltration", "impact",
)
TACTIC_WORDS = {
    "initial_access": ("login", "authentication", "exploit"),
    "execution": ("process", "command", "script"),
    "persistence": ("service", "registry", "scheduled"),
    "privilege_escalation": ("elevated", "admin", "root"),
    "defense_evasion": ("delete", "clear", "disable"),
    "credential_access": ("password", "credential", "hash"),
    "discovery": ("scan", "enumerate", "query"),
    "lateral_movement": ("remote", "share", "rdp"),
    "collection": ("archive", "compress", "stage"),
    "command_and_control": ("beacon", "callback", "c2"),
    "exfiltration": ("upload", "transfer", "send"),
    "impact": ("encrypt", "destroy", "wipe"),
}
SEVERITIES = ("low", "medium", "high", "critical")


def brute_force(
    df: DataFrame,
    failed: Column,
    succeeded: Column,
    event_id: str,
    keys: Sequence[str] = ("target", "source"),
    ts: str = "ts",
    failures: int = 5,
    within_seconds: float = 600,
    segment_seconds: int = 3600,
) -> DataFrame:
    """Successes with at least `failures` failures of the same source on the same target in the time before."""
    found = range_profile(
        df, keys, succeeded, [event_id], {"failed_attempts": F.coalesce(failed, F.lit(False)).cast("double")},
        before_seconds=within_seconds, include_start=True, ts=ts, segment_seconds=segment_seconds,
    )
    return found.where(F.col("failed_attempts") >= failures)


def brute_force_slices(
    df: DataFrame,
    failed: Column,
    succeeded: Column,
    order_by: Sequence[str],
    target: str = "target",
    source: str = "source",
    ts: str = "ts",
    failures: int = 5,
    slice_rows: int = 11,
    min_events: int = 6,
    within_seconds: float = 600,
) -> DataFrame:
    """The same by sliding slices of eleven rows per target: after five failures a success of the
    source that failed first, the whole slice no longer than the time window."""
    flagged = df.withColumns(
        {"_failed": F.coalesce(failed, F.lit(False)), "_ok": F.coalesce(succeeded, F.lit(False))}
    )
    indexed = row_index(flagged, [target], order_by, ts)
    item = F.struct("row_index", "_failed", "_ok", F.col(source).cast("string").alias("src"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    framed = neighbour_frames(
        indexed, [target], "row_index", 0, slice_rows - 1, {"_slice": (F.collect_list(item), 0, slice_rows - 1)}
    ).where(F.col("row_index") <= F.col("key_rows") - min_events)
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("src"), F.lit(False).alias("done"))

    def step(state, row):
        open_ = ~state["done"]
        counted = F.when(open_ & row["_failed"], state["n"] + 1).otherwise(state["n"])
        first = F.when(open_ & row["_failed"] & state["src"].isNull(), row["src"]).otherwise(state["src"])
        hit = open_ & ~row["_failed"] & row["_ok"] & (state["n"] >= failures) & (row["src"] == state["src"])
        return F.struct(counted.alias("n"), first.alias("src"), (state["done"] | F.coalesce(hit, F.lit(False))).alias("done"))

    ordered = F.array_sort("_slice")
    state = F.aggregate(ordered, start, step)
    span = (F.element_at(ordered, -1)["us"] - F.element_at(ordered, 1)["us"]) / F.lit(float(MICROS))
    judged = framed.select(*df.columns, state.alias("_state"), span.alias("slice_seconds"))
    return judged.where(F.col("_state.done") & (F.col("slice_seconds") <= within_seconds)).select(
        *df.columns, F.col("_state.n").alias("failed_attempts"), F.col("_state.src").alias("first_source"), "slice_seconds"
    )


def lateral_movement(
    df: DataFrame,
    access: Column,
    privileged: Column,
    event_id: str,
    source: str = "source",
    target: str = "target",
    ts: str = "ts",
    targets: int = 3,
    within_seconds: float = 3600,
    segment_seconds: int = 3600,
    need_privilege: bool = True,
) -> DataFrame:
    """Access events followed within the hour by access to three distinct targets, one of it privileged."""
    accesses = df.where(F.coalesce(access, F.lit(False))).select(
        source, target, event_id, ts, F.coalesce(privileged, F.lit(False)).cast("double").alias("_priv")
    )
    reach = distinct_in_following(
        accesses, [source], target, F.lit(True), [event_id], within_seconds, ts=ts, segment_seconds=segment_seconds
    ).where(F.col(f"distinct_{target}") >= targets)
    rights = range_profile(
        accesses, [source], F.lit(True), [event_id], {"privileged": F.col("_priv"), "accesses": F.lit(1.0)},
        after_seconds=within_seconds, include_start=True, ts=ts, segment_seconds=segment_seconds,
    )
    joined = reach.join(rights, [source, event_id, "anchor_us"])
    return joined.where(F.col("privileged") > 0) if need_privilege else joined


def followed_by(
    df: DataFrame,
    first: Column,
    then: Mapping[str, Column],
    event_id: str,
    keys: Sequence[str] = ("source",),
    within_seconds: float = 3600,
    at_least: int = 1,
    ts: str = "ts",
    segment_seconds: int = 3600,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per first event of a key, with the number of each kind of later event in (t, t + within]."""
    measures = {n: F.coalesce(c, F.lit(False)).cast("double") for n, c in then.items()}
    found = range_profile(
        df, keys, first, [event_id], {**measures, **dict(sums or {})}, after_seconds=within_seconds, ts=ts,
        segment_seconds=segment_seconds,
    )
    for name in then:
        found = found.where(F.col(name) >= at_least)
    return found


def data_exfiltration(df, fields, event_id, key="source", **kwargs) -> DataFrame:
    """Suspicious access, then a large transfer to an external host within two hours."""
    from logsieve.functions.net import is_external

    destination = F.when(fields.text("destination") != "", fields.text("destination")).otherwise(fields.text("dst_ip"))
    transfer = fields.is_large_transfer() & is_external(destination)
    return followed_by(
        df, fields.is_suspicious_access(), {"transfers": transfer}, event_id, [key],
        kwargs.pop("within_seconds", RULES["data_exfiltration"]["within"]),
        sums={"bytes_transferred": F.when(transfer, fields.number("bytes"))}, **kwargs,
    )


def privilege_escalation(df, fields, event_id, key="source", **kwargs) -> DataFrame:
    """A service change, then an elevated process and a registry change within half an hour."""
    return followed_by(
        df, fields.is_service_modification(),
        {"elevated_processes": fields.is_elevated_process(), "registry_changes": fields.is_registry_change()},
        event_id, [key], kwargs.pop("within_seconds", RULES["privilege_escalation"]["within"]), **kwargs,
    )


def account_compromise(df, fields, event_id, key="user", **kwargs) -> DataFrame:
    """An unusual login, then a configuration change and sensitive access within the hour."""
    return followed_by(
        df, fields.is_unusual_login(),
        {"config_changes": fields.is_config_change(), "sensitive_accesses": fields.is_sensitive_access()},
        event_id, [key], kwargs.pop("within_seconds", RULES["account_compromise"]["within"]), **kwargs,
    )


def entity_array(columns: Sequence[str], fields: Sequence[str] = ENTITY_FIELDS) -> Column:
    """Distinct non-empty values of the entity fields an event has, sorted."""
    present = [F.when(F.col(f).cast("string") != "", F.col(f).cast("string")) for f in fields if f in columns]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*present))))


def entities(df: DataFrame, keep: Sequence[str], fields: Sequence[str] = ENTITY_FIELDS) -> DataFrame:
    return explode_computed(df, keep, entity_array(df.columns, fields), "entity")


def entity_activity(
    df: DataFrame,
    event_id: str,
    event_type: str = "event_type",
    ts: str = "ts",
    fields: Sequence[str] = ENTITY_FIELDS,
    min_events: int = 3,
    min_types: int = 3,
) -> DataFrame:
    """Entities with several events of several types."""
    rows = entities(df, [event_id, event_type, ts], fields)
    return (
        rows.groupBy("entity")
        .agg(
            F.count_distinct(event_id).alias("events"),
            F.count_distinct(event_type).alias("types"),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
        )
        .where((F.col("events") >= min_events) & (F.col("types") >= min_types))
    )


def first_events(df: DataFrame, found: DataFrame, event_id: str, ts: str = "ts", fields: Sequence[str] = ENTITY_FIELDS, keep: int = 20):
    """The first 20 events of each reported entity, one row each."""
    rows = entities(df, [event_id, ts], fields)
    order = W.partitionBy("entity").orderBy(ts, event_id)
    ranked = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)
    return ranked.join(found.select("entity"), "entity", "left_semi")


def infer_tactics(event_text: Column) -> Column:
    """Tactics one of whose words occurs in the whole event."""
    lowered = F.lower(event_text)
    return F.array_compact(F.array(*[F.when(contains_any(lowered, words), F.lit(t)) for t, words in TACTIC_WORDS.items()]))


def _severity_rank(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col)


def _severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def merge_findings(findings: DataFrame, finding_entries: DataFrame, share: float = 0.5) -> DataFrame:
    """Findings that share half of the smaller one's events, joined into groups.

    Groups are the connected components of the overlap relation, so the result does not
    depend on the order of the findings. Findings over the very same events are one set.
    """
    members, tokens = distinct_sets(finding_entries, "finding_id", "entry_id")
    pairs = containment_pairs(tokens, share)
    components = connected_components(pairs.select(F.col("a_set").alias("u"), F.col("b_set").alias("v")))
    grouped = (
        members.join(components.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("finding_id", F.coalesce("component", "set_id").alias("group_id"))
    )
    rows = findings.join(grouped, "finding_id", "left").withColumn("group_id", F.coalesce("group_id", "finding_id"))
    merged = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.max("confidence").alias("confidence"),
        F.max_by("type", F.struct("confidence", "type")).alias("type"),
        _severity_name(F.max(_severity_rank(F.col("severity")))).alias("severity"),
    )
    events = (
        grouped.join(finding_entries, "finding_id").select("group_id", "entry_id").distinct()
        .groupBy("group_id").agg(F.count(F.lit(1)).alias("events"))
    )
    return merged.join(events, "group_id", "left")


def finding_groups(finding_entries: DataFrame, share: float = 0.5) -> DataFrame:
    """(finding_id, group_id) of the same grouping."""
    members, tokens = distinct_sets(finding_entries, "finding_id", "entry_id")
    pairs = containment_pairs(tokens, share)
    components = connected_components(pairs.select(F.col("a_set").alias("u"), F.col("b_set").alias("v")))
    return members.join(components.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "finding_id", F.coalesce("component", "set_id").alias("group_id")
    )


def attack_chains(findings: DataFrame, min_findings: int = 2, min_tactics: int = 3) -> DataFrame:
    """Entities with several findings that together cover three tactics.

    `findings` has entities, tactics (arrays), first_ts, last_ts, confidence and severity.
    Lists are gathered from one row per (entity, tactic), of which there are 14 at most.
    """
    per_entity = findings.select(F.explode(F.array_distinct("entities")).alias("entity"), "tactics", "first_ts", "last_ts", "confidence", "severity")
    totals = per_entity.groupBy("entity").agg(
        F.count(F.lit(1)).alias("findings"),
        F.min("confidence").alias("confidence"),
        F.min(_severity_rank(F.col("severity"))).alias("_low"),
        F.max(_severity_rank(F.col("severity"))).alias("_high"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    ).where(F.col("findings") >= min_findings)
    position = F.array_position(F.array(*[F.lit(t) for t in TACTIC_ORDER]), F.col("tactic"))
    stages = (
        per_entity.select("entity", "first_ts", F.explode("tactics").alias("tactic"))
        .groupBy("entity", "tactic")
        .agg(F.min("first_ts").alias("tactic_ts"))
        .withColumn("_pos", F.when(position > 0, position).otherwise(999))
    )
    chains = stages.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_tactics"),
        F.array_sort(F.collect_list(F.struct("_pos", "tactic", "tactic_ts"))).alias("_stages"),
    ).where(F.col("n_tactics") >= min_tactics)
    return totals.join(chains, "entity").select(
        "entity", "findings", "n_tactics",
        F.transform("_stages", lambda x: x["tactic"]).alias("tactics"),
        F.transform("_stages", lambda x: F.struct(x["tactic"], x["tactic_ts"])).alias("stages"),
        ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(float(MICROS))).alias("duration_seconds"),
        "confidence",
        _severity_name(F.col("_low")).alias("severity"),
        _severity_name(F.col("_high")).alias("max_severity"),
    )


def correlation_summary(findings: DataFrame) -> DataFrame:
    """Counts by type and by severity and the number of distinct entities, as (facet, value, n) rows."""
    counts = findings.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))
    by_type = counts.groupBy(F.lit("type").alias("facet"), F.col("type").alias("value")).agg(F.sum("n").alias("n"))
    by_severity = counts.groupBy(F.lit("severity").alias("facet"), F.col("severity").alias("value")).agg(F.sum("n").alias("n"))
    named = findings.select(F.explode("entities").alias("e")).agg(F.count_distinct("e").alias("n")).select(
        F.lit("entities").alias("facet"), F.lit("distinct").alias("value"), "n"
    )
    return by_type.unionByName(by_severity).unionByName(named)

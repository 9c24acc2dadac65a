"""Behaviour patterns in messages: classes of activity, indicators with context, sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.functions.text import contains_any
from logsieve.operators.ordered import MICROS, neighbour_frames, range_profile, row_index

# fixed values: classes of behaviour, two patterns each
BEHAVIOURS = {
    "credential_access": (
        r"(?i)(lsass|sam\.hive|ntds\.dit|hashdump|mimikatz)", r"(?i)(password|credential|secret).*dump",
    ),
    "discovery": (
        r"(?i)(net\s+view|net\s+user|net\s+group|whoami|ipconfig|ifconfig)",
        r"(?i)(systeminfo|hostname|arp\s+-a|route\s+print)",
    ),
    "execution": (r"(?i)(powershell|cmd|bash|sh).*(-c|-command|/c)", r"(?i)(invoke-expression|iex|eval|exec)"),
    "collection": (
        r"(?i)(compress|zip|rar|7z|tar).*\.(zip|rar|7z|tar)", r"(?i)(copy|xcopy|robocopy|cp|rsync).*\*",
    ),
    "impact": (r"(?i)(delete|remove|destroy|wipe|format)", r"(?i)(shutdown|reboot|stop-computer|halt)"),
}
# fixed values: indicators of behaviour
INDICATORS: dict[str, dict] = {
    "lateral_movement": {
        "words": ("remote connection", "psexec", "wmic", "rdp", "ssh"), "severity": "high",
    },
    "privilege_escalation": {
        "words": ("elevation", "admin", "root", "sudo", "runas"), "severity": "high", "context": True,
    },
    "persistence_mechanism": {
        "words": ("registry", "startup", "scheduled task", "cron", "service"), "severity": "high",
    },
    "defense_evasion": {"words": ("disable", "stop", "kill", "bypass", "clear log"), "severity": "high"},
    "ransomware_behavior": {
        "words": ("encrypt", "locked", "ransom", "bitcoin", ".locked"), "severity": "critical",
    },
    "supply_chain": {
        "words": ("update", "patch", "installer", "signed", "certificate"), "severity": "critical",
    },
}
CONTEXT_WORDS = ("success", "failure", "error", "denied", "granted", "admin", "root")
CONTEXT_ROWS = 5

# fixed values: stages of attack sequences, and the words that mark them
SEQUENCES = {
    "kill_chain": (
        ("recon", "discovery", "scan"), ("exploit", "execution", "powershell"), ("privilege_escalation", "elevation"),
        ("credential_access", "dump"), ("lateral_movement", "remote"), ("collection", "archive"),
        ("exfiltration", "upload"),
    ),
    "ransomware_chain": (
        ("initial_access", "phishing", "download"), ("execution", "script"), ("defense_evasion", "disable"),
        ("discovery", "enumerate"), ("impact", "encrypt", "ransom"),
    ),
}
# fixed values: advice by pattern
ADVICE = {
    "brute_force": (
        "Implement account lockout policies", "Enable multi-factor authentication", "Review failed login sources",
    ),
    "port_scan": ("Review firewall rules", "Implement port scan detection", "Block scanning source IPs"),
    "lateral_movement": (
        "Segment network access", "Review privileged account usage", "Implement jump box controls",
    ),
    "data_exfiltration": ("Implement DLP controls", "Monitor outbound traffic", "Review data access logs"),
    "privilege_escalation": (
        "Audit privileged accounts", "Implement least privilege", "Monitor elevation events",
    ),
    "persistence_mechanism": (
        "Audit startup locations", "Review scheduled tasks", "Monitor registry changes",
    ),
    "defense_evasion": (
        "Harden security tools", "Implement tamper protection", "Monitor security tool status",
    ),
    "command_control": (
        "Block known C2 infrastructure", "Implement egress filtering", "Monitor periodic connections",
    ),
    "ransomware_behavior": (
        "Isolate affected systems immediately", "Verify backup integrity", "Implement ransomware protection",
    ),
}
DEFAULT_ADVICE = (
    "Investigate detected pattern", "Review security logs", "Consider additional monitoring",
)


def behaviour_names(message: Column) -> Column:
    """Classes one of whose patterns is found."""
    return F.array_compact(
        F.array(*[F.when(message.rlike(a) | message.rlike(b), F.lit(n)) for n, (a, b) in BEHAVIOURS.items()])
    )


def behaviour_tags(df: DataFrame, message: str = "message", keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    return explode_computed(df, keep, behaviour_names(F.col(message)), "behaviour")


def behavioural_indicators(
    df: DataFrame,
    order_by: Sequence[str],
    per: Sequence[str] = ("file_id",),
    message: str = "message",
    ts: str = "ts",
    entry: str = "entry_id",
    indicators: Mapping[str, Mapping] | None = None,
    windows: Mapping[str, tuple[float, int]] | None = None,
    need_evidence: bool = True,
) -> DataFrame:
    """Rows with an indicator word that is backed by evidence.

    Evidence is a context word within five rows before or after, for indicators that ask
    for context, and enough rows with the same words within `windows[name] = (seconds,
    threshold)`. Without `need_evidence` every row with a word is reported.
    """
    chosen = dict(indicators or INDICATORS)
    windows = dict(windows or {})
    per = list(per)
    lowered = F.lower(message)
    flagged = df.select(
        *dict.fromkeys([*per, entry, *order_by, ts]),
        contains_any(lowered, CONTEXT_WORDS).alias("_context"),
        *[contains_any(lowered, spec["words"]).alias(f"_i_{n}") for n, spec in chosen.items()],
    )
    indexed = row_index(flagged, per, order_by, ts)
    framed = neighbour_frames(
        indexed, per, "row_index", CONTEXT_ROWS, CONTEXT_ROWS,
        {"_near": (F.max(F.col("_context").cast("int")), -CONTEXT_ROWS, CONTEXT_ROWS)},
    )
    for name, (seconds, _) in windows.items():
        counts = range_profile(
            flagged, per, F.col(f"_i_{name}"), [entry], {f"_n_{name}": F.col(f"_i_{name}").cast("double")},
            before_seconds=seconds, after_seconds=seconds, include_start=True, ts=ts,
        ).drop("anchor_us")
        framed = framed.join(counts, [*per, entry], "left")
    parts = []
    for name, spec in chosen.items():
        evidence = F.lit(0)
        if spec.get("context"):
            evidence = evidence + F.col("_near")
        if name in windows:
            enough = F.coalesce(F.col(f"_n_{name}"), F.lit(0.0)) >= windows[name][1]
            evidence = evidence + enough.cast("int")
        boost = F.least(evidence * 0.1, F.lit(0.3)) + (0.1 if spec["severity"] == "critical" else 0.0)
        parts.append(
            F.when(
                F.col(f"_i_{name}") & ((evidence > 0) if need_evidence else F.lit(True)),
                F.struct(
                    F.lit(name).alias("indicator"),
                    F.lit(spec["severity"]).alias("severity"),
                    F.least(F.lit(0.6) + boost, F.lit(0.95)).alias("confidence"),
                ),
            )
        )
    found = explode_computed(framed, [*per, entry], F.array_compact(F.array(*parts)), "_h")
    return found.select(*per, entry, "_h.*")


def recon_before_execution(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    entry: str = "entry_id",
    message: str = "message",
    ts: str = "ts",
    within_seconds: float = 3600,
) -> DataFrame:
    """Discovery rows followed by an execution row within the hour, with the first such row's delay."""
    names = behaviour_names(F.col(message))
    tagged = df.select(
        *dict.fromkeys([*keys, entry, ts]),
        F.array_contains(names, "discovery").alias("_discovery"),
        F.array_contains(names, "execution").alias("_execution"),
    )
    found = range_profile(
        tagged, keys, F.col("_discovery"), [entry], {"_any": F.lit(0.0)},
        next_of={"execution": F.col("_execution")}, ts=ts,
    )
    gap = (F.col("execution_us") - F.col("anchor_us")) / F.lit(float(MICROS))
    return found.where(gap < within_seconds).select(*keys, entry, gap.alias("gap_seconds"))


def message_network_fields(df: DataFrame, message: str = "message", keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    """Addresses and ports named in messages, as arrays per row."""
    m = F.col(message)
    ip = r"(\d+\.\d+\.\d+\.\d+)"
    return df.select(
        *keep,
        F.regexp_extract_all(m, F.lit(r"src[:\s]+" + ip), F.lit(1)).alias("src_ips"),
        F.regexp_extract_all(m, F.lit(r"dst[:\s]+" + ip), F.lit(1)).alias("dst_ips"),
        F.filter(
            F.transform(F.regexp_extract_all(m, F.lit(r"(?i)port[:\s]+(\d+)"), F.lit(1)), lambda p: p.try_cast("int")),
            lambda p: p < 65536,
        ).alias("ports"),
    )


def message_ip_pairs(fields: DataFrame) -> DataFrame:
    """How often each source and destination are named together."""
    return (
        fields.select(F.explode("src_ips").alias("src"), "dst_ips")
        .select("src", F.explode("dst_ips").alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def message_ip_ports(fields: DataFrame) -> DataFrame:
    """Rows (ip, port) of every address and port named in one message."""
    return fields.select(F.explode(F.concat("src_ips", "dst_ips")).alias("ip"), "ports").select(
        "ip", F.explode("ports").alias("port")
    )


def sequence_stages(spark: SparkSession) -> DataFrame:
    rows = [
        (chain, n, stage[0], word)
        for chain, stages in SEQUENCES.items()
        for n, stage in enumerate(stages)
        for word in stage
    ]
    return spark.createDataFrame(rows, "chain string, stage_no int, stage string, word string")


def attack_sequences(patterns: DataFrame, min_stages: int = 3) -> DataFrame:
    """Chains with at least three stages among the found patterns (columns name, confidence, found_order).

    A stage takes the first pattern in order of finding. Patterns are reduced to their
    names first, so the join with the fixed stage words is over names.
    """
    names = patterns.groupBy(F.lower("name").alias("name")).agg(
        F.min_by("confidence", "found_order").alias("confidence"), F.min("found_order").alias("found_order")
    )
    staged = F.array_compact(
        F.array(
            *[
                F.when(
                    contains_any(F.col("name"), stage),
                    F.struct(F.lit(chain).alias("chain"), F.lit(n).alias("stage_no"), F.lit(stage[0]).alias("stage")),
                )
                for chain, stages in SEQUENCES.items()
                for n, stage in enumerate(stages)
            ]
        )
    )
    hits = explode_computed(names, ["name", "confidence", "found_order"], staged, "_s").select("_s.*", "name", "confidence", "found_order")
    first = hits.groupBy("chain", "stage_no", "stage").agg(
        F.min_by(F.struct("name", "confidence"), "found_order").alias("_p")
    )
    return (
        first.groupBy("chain")
        .agg(
            F.count(F.lit(1)).alias("stages"),
            F.avg("_p.confidence").alias("confidence"),
            # at most one entry per stage of the chain
            F.array_sort(F.collect_list(F.struct("stage_no", "stage", F.col("_p.name").alias("pattern")))).alias("evidence"),
        )
        .where(F.col("stages") >= min_stages)
    )


def advice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, list(a)) for n, a in ADVICE.items()], "name string, advice array<string>")


def with_advice(patterns: DataFrame, name: str = "name") -> DataFrame:
    known = advice_table(patterns.sparkSession).withColumnRenamed("name", name)
    joined = patterns.join(known, name, "left")
    return joined.withColumn("advice", F.coalesce("advice", F.array(*[F.lit(a) for a in DEFAULT_ADVICE])))

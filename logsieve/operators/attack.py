"""Findings mapped to attack techniques and tactics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.functions.text import contains_any, is_dga_by_consonants, is_phishing_domain
from logsieve.operators.stats import with_scalars

# fixed values: the technique catalogue: name, tactics, sub-techniques
TECHNIQUES = {
    "T1059": (
        "Command and Scripting Interpreter", ("Execution",),
        {
            "T1059.001": "PowerShell", "T1059.003": "Windows Command Shell", "T1059.004": "Unix Shell",
            "T1059.005": "Visual Basic", "T1059.006": "Python", "T1059.007": "JavaScript",
        },
    ),
    "T1055": (
        "Process Injection", ("Defense Evasion", "Privilege Escalation"),
        {
            "T1055.001": "Dynamic-link Library Injection", "T1055.002": "Portable Executable Injection",
            "T1055.003": "Thread Execution Hijacking",
        },
    ),
    "T1003": (
        "OS Credential Dumping", ("Credential Access",),
        {
            "T1003.001": "LSASS Memory", "T1003.002": "Security Account Manager", "T1003.003": "NTDS",
            "T1003.008": "/etc/passwd and /etc/shadow",
        },
    ),
    "T1053": (
        "Scheduled Task/Job", ("Execution", "Persistence", "Privilege Escalation"),
        {"T1053.002": "At", "T1053.003": "Cron", "T1053.005": "Scheduled Task"},
    ),
    "T1547": (
        "Boot or Logon Autostart Execution", ("Persistence", "Privilege Escalation"),
        {
            "T1547.001": "Registry Run Keys / Startup Folder", "T1547.004": "Winlogon Helper DLL",
            "T1547.009": "Shortcut Modification",
        },
    ),
    "T1110": (
        "Brute Force", ("Credential Access",),
        {
            "T1110.001": "Password Guessing", "T1110.002": "Password Cracking", "T1110.003": "Password Spraying",
            "T1110.004": "Credential Stuffing",
        },
    ),
    "T1505": (
        "Server Software Component", ("Persistence",),
        {"T1505.003": "Web Shell", "T1505.004": "IIS Components", "T1505.005": "Terminal Services DLL"},
    ),
    "T1486": ("Data Encrypted for Impact", ("Impact",), {}),
    "T1041": ("Exfiltration Over C2 Channel", ("Exfiltration",), {}),
    "T1071": (
        "Application Layer Protocol", ("Command and Control",),
        {
            "T1071.001": "Web Protocols", "T1071.002": "File Transfer Protocols", "T1071.003": "Mail Protocols",
            "T1071.004": "DNS",
        },
    ),
    "T1018": ("Remote System Discovery", ("Discovery",), {}),
    "T1046": ("Network Service Discovery", ("Discovery",), {}),
    "T1068": ("Exploitation for Privilege Escalation", ("Privilege Escalation",), {}),
    "T1566": (
        "Phishing", ("Initial Access",),
        {
            "T1566.001": "Spearphishing Attachment", "T1566.002": "Spearphishing Link",
            "T1566.003": "Spearphishing via Service",
        },
    ),
    "T1496": ("Resource Hijacking", ("Impact",), {}),
}
TACTIC_ORDER = (
    "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
)
# fixed values: behaviours to techniques with their base confidence
BEHAVIOUR_TECHNIQUES = {
    "process_injection": (("T1055", 0.95),),
    "credential_dumping": (("T1003", 0.95),),
    "port_scanning": (("T1046", 0.9),),
    "persistence_mechanism": (("T1547", 0.85), ("T1053", 0.8)),
    "brute_force": (("T1110", 0.95),),
    "data_exfiltration": (("T1041", 0.9), ("T1048", 0.8)),
    "recon_commands": (("T1018", 0.8), ("T1016", 0.8)),
}
# fixed values: wording of behaviours
BEHAVIOUR_TESTS = {
    "process_injection": r"createremotethread|setthreadcontext|writeprocessmemory",
    "credential_dumping": r"lsass|sam\.hive|ntds\.dit|hashdump",
    "port_scanning": r"port\s+scan|nmap|masscan|portscan",
    "persistence_mechanism": r"registry\.\*run|schtasks|scheduled task|crontab",
    "brute_force": r"failed login|authentication failure",
    "data_exfiltration": r"large data transfer|unusual upload|data sent",
    "recon_commands": r"net view|net user|whoami|ipconfig|ifconfig",
}
# fixed values: tools to techniques
TOOL_TECHNIQUES = {
    "mimikatz": (("T1003.001", 0.95), ("T1003", 0.9)),
    "lazagne": (("T1555", 0.9), ("T1003", 0.8)),
    "pwdump": (("T1003.002", 0.95),),
    "psexec": (("T1021.002", 0.95), ("T1570", 0.8)),
    "cobalt_strike": (("T1071", 0.9), ("T1055", 0.85)),
    "metasploit": (("T1210", 0.8), ("T1055", 0.8)),
    "empire": (("T1547", 0.85), ("T1053", 0.8)),
    "schtasks": (("T1053.005", 0.95),),
    "nmap": (("T1046", 0.95), ("T1018", 0.8)),
    "masscan": (("T1046", 0.95),),
    "rclone": (("T1567.002", 0.9),),
    "curl": (("T1041", 0.7), ("T1105", 0.7)),
    "wget": (("T1105", 0.8),),
}
# fixed values: words of signature names to techniques
SIGNATURE_WORDS = (
    ("powershell", "T1059.001", 0.9), ("ransomware", "T1486", 0.95), ("webshell", "T1505.003", 0.95),
    ("credential", "T1003", 0.9), ("persistence", "T1547", 0.85), ("miner", "T1496", 0.9),
)
# fixed values: mitigations
MITIGATIONS = {
    "T1059": ("Application control", "Code signing", "Execution prevention"),
    "T1055": ("Behavior monitoring", "Privileged account management"),
    "T1003": ("Credential access protection", "Password policies", "Privileged account management"),
    "T1053": ("Audit", "Operating system configuration", "Privileged account management"),
    "T1547": ("Audit", "User account management"),
    "T1110": ("Account use policies", "Multi-factor authentication", "Password policies"),
    "T1505.003": ("Audit", "File monitoring", "Update software"),
    "T1486": ("Data backup", "User training"),
    "T1041": ("Data loss prevention", "Network intrusion prevention"),
    "T1496": ("Resource monitoring", "User account management"),
}
# fixed values: techniques by weight
URGENT_TECHNIQUES = ("T1003", "T1486")
CRITICAL_TECHNIQUES = ("T1486", "T1003", "T1055", "T1505.003")
HIGH_TECHNIQUES = ("T1059", "T1053", "T1547", "T1110")
IMPACT_TECHNIQUES = ("T1486", "T1496", "T1041")
THRESHOLD = 0.6


def techniques_table(spark: SparkSession) -> DataFrame:
    rows = [(t, name, list(tactics)) for t, (name, tactics, _) in TECHNIQUES.items()]
    return spark.createDataFrame(rows, "technique string, name string, tactics array<string>")


def sub_techniques_table(spark: SparkSession) -> DataFrame:
    rows = [(t, s, n) for t, (_, _, subs) in TECHNIQUES.items() for s, n in subs.items()]
    return spark.createDataFrame(rows, "technique string, sub_technique string, sub_name string")


def tactics_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TACTIC_ORDER)], "tactic string, tactic_no int")


def _pick(technique: str, confidence: float, evidence: str, value: Column) -> Column:
    return F.struct(
        F.lit(technique).alias("technique"), F.lit(confidence).alias("confidence"),
        F.concat(F.lit(evidence), value).alias("evidence"),
    )


def map_iocs(iocs: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """Techniques that an indicator points to; `feed(ioc_value, threat_type)` adds Tor exits and command servers.

    Works on distinct indicators.
    """
    values = iocs.select("ioc_type", "ioc_value").distinct()
    v, low, kind = F.col("ioc_value"), F.lower("ioc_value"), F.col("ioc_type")
    picks = F.array_compact(
        F.array(
            F.when((kind == "domains") & is_dga_by_consonants(v), _pick("T1568.002", 0.9, "DGA domain: ", v)),
            F.when((kind == "domains") & is_phishing_domain(v), _pick("T1566", 0.9, "Phishing domain: ", v)),
            F.when((kind == "urls") & contains_any(low, ("download", "update")), _pick("T1105", 0.7, "Download URL: ", v)),
            F.when((kind == "urls") & contains_any(low, (".ps1", ".vbs", ".js", ".bat")), _pick("T1059", 0.8, "Script URL: ", v)),
            F.when((kind == "file_paths") & low.contains("temp"), _pick("T1036", 0.6, "Suspicious temp path: ", v)),
            F.when(
                (kind == "file_paths") & contains_any(low, ("startup", "run", "autostart")),
                _pick("T1547.001", 0.8, "Persistence path: ", v),
            ),
            F.when((kind == "hashes") & F.length(v).isin(32, 40, 64), _pick("T1204", 0.5, "File hash: ", v)),
        )
    )
    found = explode_computed(values, [], picks, "_p").select("_p.*")
    if feed is not None:
        listed = values.where("ioc_type = 'ips'").join(feed.select("ioc_value", "threat_type").distinct(), "ioc_value")
        tor, c2 = F.col("threat_type") == "tor_exit", F.col("threat_type") == "known_c2"
        more = F.array_compact(
            F.array(
                F.when(tor, _pick("T1090.003", 0.8, "Tor exit node: ", v)),
                F.when(c2, _pick("T1071", 0.9, "Known C2 IP: ", v)),
                F.when(c2, _pick("T1041", 0.7, "Potential exfiltration to: ", v)),
            )
        )
        found = found.unionByName(explode_computed(listed, [], more, "_p").select("_p.*"))
    return found


def _technique_rows(spark: SparkSession, table: dict, key: str) -> DataFrame:
    rows = [(k, t, c) for k, pairs in table.items() for t, c in pairs]
    return spark.createDataFrame(rows, f"{key} string, technique string, base double")


def behaviour_counts(df: DataFrame, message: str = "message") -> DataFrame:
    low = F.lower(message)
    names = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in BEHAVIOUR_TESTS.items()]))
    return explode_computed(df, [], names, "behaviour").groupBy("behaviour").agg(F.count(F.lit(1)).alias("n"))


def map_behaviours(df: DataFrame, message: str = "message") -> DataFrame:
    counts = behaviour_counts(df, message)
    mapped = counts.join(_technique_rows(df.sparkSession, BEHAVIOUR_TECHNIQUES, "behaviour"), "behaviour")
    return mapped.select(
        "technique",
        F.least(F.col("base") + F.col("n") * 0.05, F.lit(1.0)).alias("confidence"),
        F.concat("behaviour", F.lit(" detected "), F.col("n").cast("string"), F.lit(" times")).alias("evidence"),
    )


def map_signatures(matches: DataFrame) -> DataFrame:
    """The technique a signature names, else what its name suggests."""
    rules = matches.groupBy("rule", "mitre_technique").agg(F.max("confidence").alias("confidence"))
    low = F.lower("rule")
    technique = F.lit(None).cast("string")
    trust = F.lit(None).cast("double")
    for word, t, c in reversed(SIGNATURE_WORDS):
        technique = F.when(low.contains(word), t).otherwise(technique)
        trust = F.when(low.contains(word), c).otherwise(trust)
    named = F.coalesce(F.col("mitre_technique"), F.lit("")) != ""
    return rules.select(
        F.when(named, F.col("mitre_technique")).otherwise(technique).alias("technique"),
        F.when(named, F.coalesce("confidence", F.lit(0.8))).otherwise(trust).alias("confidence"),
        F.concat(F.lit("Signature: "), "rule").alias("evidence"),
    ).where(F.col("technique").isNotNull())


def map_sigma(consolidated: DataFrame) -> DataFrame:
    """All technique tags of the rules that matched."""
    techniques = F.transform(
        F.filter("tags", lambda t: t.startswith("attack.t")), lambda t: F.upper(F.replace(t, F.lit("attack."), F.lit("")))
    )
    rows = explode_computed(consolidated, ["title", "confidence"], F.array_distinct(techniques), "technique")
    return rows.select("technique", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.concat(F.lit("Rule: "), "title").alias("evidence"))


def map_tools(df: DataFrame, message: str = "message") -> DataFrame:
    low = F.lower(message)
    tools = F.filter(F.array(*[F.lit(t) for t in TOOL_TECHNIQUES]), lambda t: F.contains(low, t))
    counts = explode_computed(df, [], tools, "tool").groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    mapped = counts.join(_technique_rows(df.sparkSession, TOOL_TECHNIQUES, "tool"), "tool")
    return mapped.select("technique", F.col("base").alias("confidence"), F.concat(F.lit("Tool: "), "tool").alias("evidence"))


def technique_scores(*mappings: DataFrame, threshold: float = THRESHOLD, evidence_rows: int = 100) -> DataFrame:
    """Highest confidence per known technique, with sub-techniques that were also found."""
    rows = mappings[0]
    for more in mappings[1:]:
        rows = rows.unionByName(more)
    scores = rows.groupBy("technique").agg(
        F.max("confidence").alias("confidence"), F.count_distinct("evidence").alias("evidence_count"),
        F.min("evidence").alias("first_evidence"),
    )
    spark = rows.sparkSession
    known = scores.where(F.col("confidence") >= threshold).join(techniques_table(spark), "technique")
    subs = sub_techniques_table(spark).join(
        scores.select(F.col("technique").alias("sub_technique"), F.col("confidence").alias("sub_confidence")), "sub_technique"
    )
    # a technique has a handful of sub-techniques in the catalogue
    grouped = subs.groupBy("technique").agg(
        F.array_sort(F.collect_list(F.struct("sub_technique", "sub_name", F.round("sub_confidence", 2).alias("confidence")))).alias("sub_techniques")
    )
    return known.join(grouped, "technique", "left").withColumn("confidence", F.round("confidence", 2))


def technique_evidence(*mappings: DataFrame) -> DataFrame:
    """All distinct evidence of each technique, one row each."""
    rows = mappings[0]
    for more in mappings[1:]:
        rows = rows.unionByName(more)
    return rows.select("technique", "evidence").distinct()


def tactic_summary(techniques: DataFrame) -> DataFrame:
    return (
        techniques.select("technique", F.explode("tactics").alias("tactic"))
        .groupBy("tactic")
        .agg(F.count(F.lit(1)).alias("technique_count"), F.array_sort(F.collect_list("technique")).alias("techniques"))
    )


def tactic_chain(techniques: DataFrame) -> DataFrame:
    """Best technique of each tactic, in the order of an attack."""
    rows = techniques.select("technique", "name", "confidence", "first_evidence", F.explode("tactics").alias("tactic"))
    order = W.partitionBy("tactic").orderBy(F.desc("confidence"), "technique")
    best = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return best.join(tactics_table(techniques.sparkSession), "tactic")


# fixed values: advice on an assessment
ASSESSMENT_ADVICE = (
    "Immediate incident response required", "Isolate affected systems", "Reset all credentials immediately",
    "Check and secure backups", "Implement ransomware protection", "Audit persistence mechanisms",
)


def threat_assessment(techniques: DataFrame) -> DataFrame:
    """One row: severity, sophistication, impact, confidence of detection and advice."""
    t = F.col("technique")
    has = lambda names: F.count_if(t.isin(*names))
    totals = techniques.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        has(CRITICAL_TECHNIQUES).alias("critical"), has(HIGH_TECHNIQUES).alias("high"), has(IMPACT_TECHNIQUES).alias("impact"),
        has(("T1003",)).alias("dumping"), has(("T1486",)).alias("encryption"), has(("T1053", "T1547")).alias("persistence"),
    )
    tactics = techniques.select(F.explode("tactics").alias("tactic")).agg(F.count_distinct("tactic").alias("tactics"))
    both = with_scalars(totals, tactics)
    severity = (
        F.when(F.col("critical") > 0, "critical").when(F.col("high") >= 2, "high")
        .when((F.col("high") >= 1) | (F.col("n") >= 3), "medium").otherwise("low")
    )
    urgent = F.col("severity").isin("critical", "high")
    conditions = (urgent, urgent, F.col("dumping") > 0, F.col("encryption") > 0, F.col("encryption") > 0, F.col("persistence") > 0)
    advice = F.array_compact(F.array(*[F.when(c, F.lit(a)) for c, a in zip(conditions, ASSESSMENT_ADVICE, strict=True)]))
    return both.withColumn("severity", severity).select(
        "severity",
        F.when(F.col("tactics") >= 5, "high").when(F.col("tactics") >= 3, "medium").otherwise("low").alias("sophistication"),
        F.when(F.col("impact") > 0, "high").when(F.col("n") >= 5, "medium").otherwise("low").alias("impact_potential"),
        F.when(F.col("mean_confidence") >= 0.85, "high").when(F.col("mean_confidence") >= 0.7, "medium").otherwise("low")
        .alias("detection_confidence"),
        advice.alias("advice"),
    )


def mitigations(techniques: DataFrame) -> DataFrame:
    """Advice for the techniques found, each piece once, with the first technique it answers and its priority."""
    spark = techniques.sparkSession
    rows = [(t, i, m) for i, (t, ms) in enumerate(MITIGATIONS.items()) for m in ms]
    table = spark.createDataFrame(rows, "technique string, _no int, mitigation string")
    found = table.join(techniques.select("technique"), "technique", "left_semi")
    first = found.groupBy("mitigation").agg(F.min_by("technique", "_no").alias("technique"))
    return first.withColumn("priority", F.when(F.col("technique").isin(*URGENT_TECHNIQUES), "high").otherwise("medium"))


def names_of(techniques: Sequence[str]) -> dict[str, str]:
    return {t: TECHNIQUES[t][0] for t in techniques if t in TECHNIQUES}

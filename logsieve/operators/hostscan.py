"""Registry values, processes, strings, file listings, archives and document text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import host
from logsieve.functions.rows import explode_computed
from logsieve.functions.text import contains_any, matched_names

# fixed values: keys that start programs
PERSISTENCE_KEYS = {
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run": "User Run",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce": "User RunOnce",
    "SOFTWARE\\Wow6432Node\\Microsoft\\Windows\\CurrentVersion\\Run": "User Run (32-bit)",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunServices": "RunServices",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunServicesOnce": "RunServicesOnce",
    "SYSTEM\\CurrentControlSet\\Services": "Services",
    "SYSTEM\\CurrentControlSet\\Control\\Session Manager\\BootExecute": "BootExecute",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\Shell Folders": "Shell Folders",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\User Shell Folders": "User Shell Folders",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\Browser Helper Objects": "Browser Helper Objects",
    "SYSTEM\\CurrentControlSet\\Control\\SecurityProviders": "Security Providers",
    "SYSTEM\\CurrentControlSet\\Control\\Lsa": "LSA",
    "SYSTEM\\CurrentControlSet\\Control\\NetworkProvider\\Order": "Network Providers",
    "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon": "Winlogon",
    "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\Notify": "Winlogon Notify",
    "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\AppInit_DLLs": "AppInit DLLs",
    "SOFTWARE\\Wow6432Node\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\AppInit_DLLs": "AppInit DLLs (32-bit)",
    "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Image File Execution Options": "IFEO",
    "SOFTWARE\\Classes": "File Associations",
    "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Schedule\\TaskCache": "Scheduled Tasks",
}
VALUE_PATTERNS = {
    "powershell": r"(?i)powershell.*(-enc|-e\s|iex|downloadstring)",
    "wscript": r"(?i)(wscript|cscript).*\.(js|jse|vbs|vbe|wsf)",
    "mshta": r"(?i)mshta.*http",
    "regsvr32": r"(?i)regsvr32.*/s.*(/u\s|/i:|scrobj)",
    "rundll32": r"(?i)rundll32.*javascript:|shell32",
    "encoded_command": r"(?i)(-enc|-e\s+)[a-z0-9+/=]{20,}",
    "temp_path": r"(?i)(%temp%|\\temp\\|\\tmp\\)",
    "http_download": r"(?i)(http|ftp)s?://[^\s]+\.(exe|dll|scr|bat|cmd|ps1)",
    "suspicious_extension": r"(?i)\.(scr|pif|cpl|hta|jar|vb[se]?|ws[fh]?)$",
}
# fixed values: names of functions and processes in strings of memory
API_GROUPS = {
    "process_injection": (
        "CreateRemoteThread", "VirtualAllocEx", "WriteProcessMemory", "SetWindowsHookEx", "SetThreadContext", "QueueUserAPC",
    ),
    "api_hooking": (
        "SetWindowsHookEx", "UnhookWindowsHookEx", "CallNextHookEx", "inline hook", "IAT hook", "EAT hook",
    ),
    "persistence": ("Run", "RunOnce", "Winlogon\\Shell", "Userinit", "ServiceDll", "AppInit_DLLs", "IFEO"),
    "network": (
        "WSASocket", "connect", "send", "recv", "InternetOpen", "InternetConnect", "HttpSendRequest", "WinHttpOpen",
    ),
    "evasion": (
        "IsDebuggerPresent", "CheckRemoteDebuggerPresent", "NtQueryInformationProcess", "GetTickCount", "Sleep", "VirtualProtect",
    ),
}
PROCESS_NAMES = (
    "svchost.exe", "csrss.exe", "winlogon.exe", "services.exe", "lsass.exe", "explorer.exe", "rundll32.exe", "regsvr32.exe",
    "powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe",
)
# fixed values: paths of interest on a disk
ARTEFACTS = {
    "shadow_copies": r"\\System Volume Information\\",
    "recycle_bin": r"\$Recycle\.Bin|\$RECYCLE\.BIN",
    "browser_data": r"\\AppData\\.*\\(Chrome|Firefox|Edge)\\",
    "registry": r"\\Windows\\System32\\config\\(SAM|SYSTEM|SOFTWARE|SECURITY)",
    "event_logs": r"\\Windows\\System32\\winevt\\Logs\\",
    "prefetch": r"\\Windows\\Prefetch\\.*\.pf",
    "temp_files": r"\\(Windows\\Temp|Users\\.*\\AppData\\Local\\Temp)\\",
    "ssh_keys": r"\.ssh\\(id_rsa|id_dsa|authorized_keys)",
    "password_files": r"(shadow|passwd|SAM|SYSTEM)$",
    "history_files": r"\.(bash_history|zsh_history|history)$",
}
SUSPICIOUS_FILES = {
    "encrypted_files": r"\.(encrypted|locked|enc|aes|gpg)$",
    "ransomware_notes": r"(README|DECRYPT|RECOVER|RESTORE).*\.(txt|html|hta)$",
    "malware_artifacts": r"\\(System32|SysWOW64)\\.*\.(tmp|dat|log)$",
    "hidden_files": r"/\.[^/]+$|\\\..*",
    "suspicious_scripts": r"\.(ps1|vbs|js|jse|wsf|wsh|bat|cmd)$",
    "packed_executables": r"UPX[0-9]|ASPack|PECompact|Themida",
    "rootkit_files": r"\\(drivers|system32\\drivers)\\.*\.sys$",
    "keylogger_logs": r"(keylog|keys|typed|keyboard).*\.(txt|log|dat)$",
}
# fixed values: archive members
MEMBER_ENDINGS = (
    ".exe", ".dll", ".scr", ".bat", ".cmd", ".com", ".pif", ".vbs", ".js", ".jar", ".ps1", ".psm1", ".app", ".dmg",
)
MEMBER_WORDS = (
    "password", "passwd", "crack", "hack", "exploit", "payload", "malware", "virus", "trojan", "backdoor",
)
DECOYS = ("jpg", "png", "pdf", "doc", "txt")
MIN_RATIO = 0.01
# fixed values: marks in document text
DOCUMENT_MARKS = {
    "javascript": (
        r"eval\s*\(", r"unescape\s*\(", r"String\.fromCharCode", r"document\.write", r"app\.alert", r"this\.exportDataObject",
        r"util\.printf", r"Collab\.collectEmailInfo",
    ),
    "shellcode": (
        r"\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}", r"%u[0-9a-fA-F]{4}%u[0-9a-fA-F]{4}", r"\x{90}{10,}", r"\\x41{100,}",
    ),
    "suspicious_api": (
        r"getAnnots", r"spell\.customDictionaryOpen", r"media\.newPlayer", r"doc\.printSeps", r"getURL\s*\(", r"submitForm\s*\(",
    ),
    "exploit": (
        r"util\.printf\s*\([^)]*%[0-9]+[dns]", r"Collab\.collectEmailInfo", r"spell\.customDictionaryOpen", r"getIcon.*\.width\s*=",
        r"app\..*\s*=\s*app\.",
    ),
}
THREAT_BANDS = ((150, "CRITICAL"), (100, "HIGH"), (50, "MEDIUM"), (20, "LOW"))


def persistence_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PERSISTENCE_KEYS.items()), "key_part string, persistence_type string")


def registry_persistence(values: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Values under a key that starts programs, one row per kind of start."""
    key = F.lower("key_path")
    kinds = F.array_compact(F.array(*[F.when(key.contains(part.lower()), F.lit(name)) for part, name in PERSISTENCE_KEYS.items()]))
    rows = values.where(F.col("event_type") == "registry_value")
    return explode_computed(rows, [*keep, "key_path", "value_name", "value_data"], kinds, "persistence_type")


def registry_suspicious(values: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Values that look like an attack, debugger hijacks, and class registrations at risk."""
    is_value = F.col("event_type") == "registry_value"
    key, name = F.col("key_path"), F.coalesce("value_name", F.lit(""))
    matched = F.when(is_value, matched_names(F.coalesce("value_data", F.lit("")), VALUE_PATTERNS)).otherwise(F.array().cast("array<string>"))
    hijack = F.when(key.contains("Image File Execution Options") & name.contains("Debugger"), F.lit("ifeo_hijack"))
    clsid = F.when(key.contains("{") & key.contains("}") & contains_any(key, ("InprocServer32", "LocalServer32")), F.lit("clsid_hijack_risk"))
    reasons = F.concat(matched, F.array_compact(F.array(hijack, clsid)))
    found = explode_computed(values, [*keep, "key_path"], reasons, "reason")
    return found.withColumn("severity", F.when(F.col("reason").isin("encoded_command", "ifeo_hijack"), "critical").otherwise("warning"))


def registry_top_keys(suspicious: DataFrame, limit: int = 10) -> DataFrame:
    """Keys with most hits and the reasons for them."""
    per_reason = suspicious.groupBy("key_path", "reason").agg(F.count(F.lit(1)).alias("_n"))
    # reasons come from the fixed list of patterns
    return (
        per_reason.groupBy("key_path").agg(F.sum("_n").alias("hits"), F.array_sort(F.collect_list("reason")).alias("reasons"))
        .orderBy(F.desc("hits"), "key_path").limit(limit)
    )


def registry_pattern_counts(suspicious: DataFrame) -> DataFrame:
    return suspicious.groupBy("reason").agg(F.count(F.lit(1)).alias("hits"))


def process_flags(df: DataFrame) -> DataFrame:
    """Reasons to look at a process row; columns that do not exist are left out."""
    have = set(df.columns)
    flags = []
    if {"name", "ppid"} <= have:
        flags.append(F.when(host.is_suspicious_process(F.col("name"), F.col("ppid")), F.lit("suspicious_process")))
    for column, test, label in (
        ("address", host.is_suspicious_connection, "suspicious_connection"), ("dll", host.is_suspicious_dll, "suspicious_dll"),
        ("registry_key", host.is_suspicious_registry_key, "suspicious_registry"),
        ("command_line", host.is_suspicious_command_line, "suspicious_command_line"), ("file_path", host.is_suspicious_path, "suspicious_file"),
    ):
        if column in have:
            flags.append(F.when(test(F.col(column)), F.lit(label)))
    return df.withColumn("reasons", F.array_compact(F.array(*flags)))


def hidden_processes(scanned: DataFrame, listed: DataFrame, pid: str = "pid") -> DataFrame:
    """Processes found by scanning that the process list does not have."""
    return scanned.join(listed.select(pid).distinct(), pid, "left_anti")


def string_indicators(strings: DataFrame, text: str = "text") -> DataFrame:
    """Distinct strings that name a suspicious function or hold the path of a well-known process."""
    t = F.col(text)
    low = F.lower(t)
    apis = [
        F.when(low.contains(p.lower()), F.struct(F.lit(group).alias("indicator"), F.lit(p).alias("pattern")))
        for group, names in API_GROUPS.items()
        for p in names
    ]
    in_path = contains_any(t, ("\\", "/"))
    names = [F.when(in_path & t.contains(p), F.struct(F.lit("process_path").alias("indicator"), F.lit(p).alias("pattern"))) for p in PROCESS_NAMES]
    found = explode_computed(strings.select(text).distinct(), [text], F.array_compact(F.array(*apis, *names)), "_i")
    return found.select(text, "_i.*")


def artefact_paths(files: DataFrame, keep: Sequence[str], path: str = "path") -> DataFrame:
    """Paths of security artefacts and suspicious files, without regard to case."""
    p = F.col(path)

    def tagged(kind, table):
        return [F.when(p.rlike(f"(?i){r}"), F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("name"))) for n, r in table.items()]

    found = F.array_compact(F.array(*tagged("artefact", ARTEFACTS), *tagged("suspicious", SUSPICIOUS_FILES)))
    return explode_computed(files, keep, found, "_a").select(*keep, "_a.*")


def archive_members(members: DataFrame, name: str = "name", size: str = "size", packed: str = "compressed_size") -> DataFrame:
    """Reasons to look at a member of an archive."""
    n, low = F.col(name), F.lower(name)
    ending = F.concat(F.lit("."), F.regexp_extract(low, r"\.([^./\\]+)$", 1))
    parts = F.split(n, r"\.")
    ratio = F.col(packed) / F.col(size)
    reasons = [F.when(ending.isin(*MEMBER_ENDINGS), F.concat(F.lit("Executable extension: "), ending))]
    reasons += [F.when(low.contains(w), F.lit(f"Suspicious name pattern: {w}")) for w in MEMBER_WORDS]
    reasons += [
        F.when((F.size(parts) > 2) & F.lower(F.get(parts, F.size(parts) - 2)).isin(*DECOYS), F.lit("Double extension")),
        F.when(F.regexp_extract(n, r"([^/\\]+)$", 1).startswith("."), F.lit("Hidden file")),
        F.when((F.col(size) > 0) & (ratio < MIN_RATIO), F.lit("Unusual compression ratio")),
    ]
    return members.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("suspicious", F.size("reasons") > 0)


def archive_summary(members: DataFrame, per: str, name: str = "name", size: str = "size", packed: str = "compressed_size") -> DataFrame:
    checked = archive_members(members, name, size, packed)
    return checked.groupBy(per).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("total_size"), F.sum(packed).alias("compressed_size"),
        F.count_if("suspicious").alias("suspicious_files"),
        F.try_divide(F.sum(packed).cast("double"), F.sum(size)).alias("ratio"),
    )


def member_types(members: DataFrame, per: str, name: str = "name") -> DataFrame:
    ending = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return members.groupBy(per, ending.alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def document_marks(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Number of marks of each kind in document text, obfuscation, and a level out of the marks."""
    t = F.col(text)
    counts = {}
    for kind, patterns in DOCUMENT_MARKS.items():
        total = F.lit(0)
        for p in patterns:
            total = total + t.rlike(p).cast("int")
        counts[kind] = total
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(t), F.lit(1))
    votes = (
        (F.regexp_count(t, F.lit(r"\\x[0-9a-fA-F]{2}")) > 50).cast("int") + (F.regexp_count(t, F.lit(r"String\.fromCharCode")) > 5).cast("int")
        + t.rlike(r"eval\s*\(").cast("int") + t.rlike(r"unescape\s*\(").cast("int")
        + (t.contains("replace") & t.contains("function")).cast("int") + (letters < 0.3).cast("int")
    )
    scored = df.select(*keep, *[c.alias(n) for n, c in counts.items()], (votes >= 2).alias("obfuscated"))
    points = (
        F.when(F.col("javascript") > 0, 20).otherwise(0) + F.when(F.col("suspicious_api") > 0, 20).otherwise(0)
        + F.when(F.col("shellcode") > 0, 50).otherwise(0) + F.when(F.col("exploit") > 0, 50).otherwise(0)
        + F.when(F.col("obfuscated"), 30).otherwise(0)
    )
    level = F.lit("SAFE")
    for bound, label in reversed(THREAT_BANDS):
        level = F.when(F.col("threat_points") >= bound, label).otherwise(level)
    return scored.withColumn("threat_points", points).withColumn("threat_level", level)


def level_of(points: Column) -> Column:
    out = F.lit("SAFE")
    for bound, label in reversed(THREAT_BANDS):
        out = F.when(points >= bound, label).otherwise(out)
    return out

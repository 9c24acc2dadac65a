"""Tests of process names, command lines, paths, libraries and registry keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsieve.functions.text import contains_any

# fixed values
COMMAND_LINE_PATTERNS = (
    "powershell.*-enc", "powershell.*-e.*", "powershell.*bypass", "powershell.*hidden", "cmd.*/c.*&.*&",
    "wmic.*process.*call.*create", "rundll32.*,.*", "regsvr32.*/s.*/n.*/u.*/i:", "mshta.*http",
    "certutil.*-decode", "bitsadmin.*/transfer", "net.*user.*/add",
)
TEMP_PATHS = (
    "\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\users\\public\\", "\\programdata\\", "\\windows\\temp\\",
    "\\recycler\\", "\\$recycle.bin\\",
)
EXECUTABLE_ENDINGS = (".exe", ".dll", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".jar", ".scr", ".com", ".pif")
DLL_NAMES = ("unknown", "malware.dll", "inject.dll", "hook.dll", "rootkit.dll", "backdoor.dll", "trojan.dll")
DLL_PATHS = ("\\temp\\", "\\tmp\\", "%temp%")
REGISTRY_PARTS = (
    "Run", "RunOnce", "RunServices", "RunServicesOnce", "Winlogon\\Shell", "Winlogon\\Userinit",
    "Windows\\CurrentVersion\\ShellServiceObjectDelayLoad", "Windows\\CurrentVersion\\Explorer\\SharedTaskScheduler",
    "Services\\", "AppInit_DLLs", "Image File Execution Options",
)
CONNECTION_PORTS = (4444, 31337, 12345, 54321, 1337, 666, 999)
PARENT_BOUND = ("csrss.exe", "winlogon.exe")
SINGLE_PROCESSES = ("lsass.exe", "services.exe")


def is_suspicious_command_line(col: Column) -> Column:
    lowered = F.lower(col)
    hit = F.lit(False)
    for pattern in COMMAND_LINE_PATTERNS:
        hit = hit | lowered.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def is_suspicious_path(col: Column) -> Column:
    lowered = F.lower(col)
    ending = F.lit(False)
    for e in EXECUTABLE_ENDINGS:
        ending = ending | lowered.endswith(e)
    return F.coalesce(contains_any(lowered, TEMP_PATHS) & ending, F.lit(False))


def is_suspicious_dll(col: Column) -> Column:
    lowered = F.lower(col)
    named = contains_any(lowered, DLL_NAMES) | contains_any(lowered, DLL_PATHS)
    return F.coalesce(named | lowered.rlike(r"^[a-f0-9]{8,}\.dll"), F.lit(False))


def is_suspicious_process(name: Column, parent: Column) -> Column:
    lowered = F.lower(name)
    wrong_parent = lowered.isin(*PARENT_BOUND) & (parent != 4)
    return F.coalesce(wrong_parent | lowered.isin(*SINGLE_PROCESSES) | name.rlike(r"[ \t\n]"), F.lit(False))


def is_suspicious_connection(address: Column) -> Column:
    port = F.regexp_extract(address, r":(\d+)$", 1).try_cast("int")
    return F.coalesce(port.isin(*CONNECTION_PORTS), F.lit(False))


def is_suspicious_registry_key(col: Column) -> Column:
    return F.coalesce(contains_any(col, REGISTRY_PARTS), F.lit(False))

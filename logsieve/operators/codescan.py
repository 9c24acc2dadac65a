"""Secrets, weaknesses, malicious code, imports and size of source files, by line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.functions.text import contains_any, mask_secret

# fixed values: (pattern, group that holds the secret, severity)
SECRETS = {
    "aws_access_key": (r"(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}", 0, "critical"),
    "aws_secret_key": (
        r"""(?:aws_secret_access_key|aws_secret_key|aws_secret)[\s:=]+['"]?([A-Za-z0-9/+=]{40})['"]?""", 1, "critical",
    ),
    "github_token": (r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}", 0, "critical"),
    "api_key": (r"""(?:api[_-]?key|apikey)[\s:=]+['"]?([A-Za-z0-9_\-]{20,})['"]?""", 1, "warning"),
    "private_key": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, "critical"),
    "jwt_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, "warning"),
    "password": (r"""(?:password|passwd|pwd)[\s:=]+['"]?([^\s'",]+)['"]?""", 1, "warning"),
    "connection_string": (r"(?:mongodb|mysql|postgres|postgresql|redis|amqp|jdbc):\/\/[^\s]+", 0, "critical"),
    "slack_token": (r"xox[baprs]-[0-9]{10,}-[0-9]{10,}-[a-zA-Z0-9]{24,}", 0, "warning"),
    "google_api": (r"AIza[0-9A-Za-z_-]{35}", 0, "warning"),
}
SKIP_MARKS = ("#", "//", "/*", "*")
# fixed values: (patterns, languages, severity)
WEAKNESSES = {
    "sql_injection": (
        (
            r"(?:SELECT|INSERT|UPDATE|DELETE).*\+.*(?:request|params|query|body)", r"(?:execute|query)\s*\([^)]*\+[^)]*\)",
            r"string\.Format\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE)", r'"\s*(?:SELECT|INSERT|UPDATE|DELETE).*"\s*\+',
            r"""f["']\s*(?:SELECT|INSERT|UPDATE|DELETE).*\{[^}]+\}""",
        ), (), "critical",
    ),
    "command_injection": (
        (
            r"(?:exec|system|popen|subprocess\.call|os\.system)\s*\([^)]*\+", r"Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+",
            r"Process\.Start\s*\([^)]*\+", r"`[^`]*\$[^`]*`", r"eval\s*\([^)]*(?:request|params|query|body)",
        ), (), "critical",
    ),
    "xss": (
        (
            r"innerHTML\s*=.*(?:request|params|query|body)", r"document\.write\s*\([^)]*(?:request|params|query|body)",
            r"(?:echo|print).*\$_(?:GET|POST|REQUEST)", r"Response\.Write\s*\([^)]*Request", r"render_template_string\s*\([^)]*request",
        ), ("javascript", "php", "python", "csharp"), "warning",
    ),
    "path_traversal": (
        (
            r"(?:open|read|include|require)\s*\([^)]*\.\.[/\\]", r"File\s*\([^)]*(?:request|params|query|body)",
            r"readFile.*\+.*(?:request|params|query|body)", r"include\s*\([^)]*\$_(?:GET|POST|REQUEST)",
        ), (), "warning",
    ),
    "weak_crypto": (
        (r"(?:MD5|SHA1)\s*\(", r"DES\.new", r"Random\s*\(\)", r"Math\.random\s*\(\)", r"ECB\s*mode"), (), "warning",
    ),
    "hardcoded_secret": (
        (
            r"""(?:secret|key|token|password)\s*=\s*["'][^"']+["']""", r"""(?:AES|DES|RSA)\.new\s*\(["'][^"']+["']""",
            r"""sign\s*\([^,]+,\s*["'][^"']+["']""",
        ), (), "warning",
    ),
}
# fixed values
MALICIOUS = {
    "reverse_shell": (
        (
            r"(?:nc|netcat|ncat).*-e.*(?:bash|sh|cmd)", r"socket.*SOCK_STREAM.*connect", r"""exec\s*\(\s*["']\/bin\/sh["']""",
            r"subprocess.*shell\s*=\s*True", r"""os\.system\s*\(["'].*\|.*nc""",
        ), (), "critical",
    ),
    "backdoor": (
        (
            r"(?:eval|exec)\s*\(\s*(?:base64|decode|decompress)", r"""__import__\s*\(["']os["']""",
            r"""globals\s*\(\)\[["']__builtins__["']""", r"""compile\s*\([^)]+,\s*["']<string>["'],\s*["']exec["']""",
        ), (), "critical",
    ),
    "data_exfiltration": (
        (
            r"requests\.(?:post|put)\s*\([^)]*sensitive", r"urllib.*urlopen\s*\([^)]*http", r"curl.*-d.*@", r"webclient\.uploadstring",
        ), (), "critical",
    ),
    "crypto_miner": (
        (
            r"stratum\+tcp:\/\/", r"(?:monero|bitcoin|ethereum).*wallet", r"coinhive|cryptonight|jsecoin", r"mining.*pool.*worker",
        ), (), "warning",
    ),
}
# fixed values
SLASHES = ("//", "/*", "*")
COMMENTS = {
    "python": ("#",), "javascript": SLASHES, "java": SLASHES, "c": SLASHES, "cpp": SLASHES, "csharp": SLASHES, "php": (*SLASHES, "#"),
    "ruby": ("#",), "go": SLASHES, "rust": SLASHES, "bash": ("#",), "powershell": ("#",), "batch": ("REM", "::"),
}
DEFAULT_COMMENTS = ("#", "//")
# fixed values
IMPORTS = {
    "python": (r"^import\s+(\S+)", r"^from\s+(\S+)\s+import"),
    "javascript": (r"""^import.*from\s+['"]([^'"]+)['"]""", r"""^require\s*\(['"]([^'"]+)['"]\)"""),
    "java": (r"^import\s+([\w.]+);",), "csharp": (r"^using\s+([\w.]+);",), "go": (r'^import\s+"([^"]+)"',), "rust": (r"^use\s+([\w:]+);",),
}
RISKY_IMPORTS = {
    "python": ("pickle", "subprocess", "os", "eval", "__import__"), "javascript": ("eval", "child_process", "vm"),
    "java": ("Runtime", "ProcessBuilder", "ScriptEngine"), "csharp": ("Process", "Diagnostics.Process"),
    "php": ("exec", "system", "eval", "shell_exec"), "ruby": ("eval", "system", "exec", "spawn"),
}


def _secrets_of(line: Column, name: str) -> Column:
    pattern, group, severity = SECRETS[name]
    found = F.regexp_extract_all(line, F.lit(f"(?i){pattern}"), F.lit(group))
    return F.transform(
        found, lambda v: F.struct(F.lit(name).alias("secret_type"), mask_secret(v).alias("masked_value"), F.lit(severity).alias("severity"))
    )


def secrets(lines: DataFrame, keep: Sequence[str], line: str = "line") -> DataFrame:
    """Secrets in lines without comment marks, masked."""
    c = F.col(line)
    rows = lines.where(~contains_any(c, SKIP_MARKS))
    found = explode_computed(rows, keep, F.concat(*[_secrets_of(c, n) for n in SECRETS]), "_s")
    return found.select(*keep, "_s.*")


def _classes(line: Column, language: Column, table: Mapping) -> Column:
    parts = []
    for name, (patterns, languages, severity) in table.items():
        first = F.coalesce(*[F.when(line.rlike(f"(?i){p}"), F.lit(p)) for p in patterns])
        applies = language.isin(*languages) if languages else F.lit(True)
        parts.append(
            F.when(applies & first.isNotNull(), F.struct(F.lit(name).alias("kind"), first.alias("pattern"), F.lit(severity).alias("severity")))
        )
    return F.array_compact(F.array(*parts))


def weaknesses(lines: DataFrame, keep: Sequence[str], line: str = "line", language: str = "language") -> DataFrame:
    """First pattern of each class of weakness in each line."""
    return explode_computed(lines, keep, _classes(F.col(line), F.col(language), WEAKNESSES), "_w").select(*keep, "_w.*")


def malicious_code(lines: DataFrame, keep: Sequence[str], line: str = "line", language: str = "language") -> DataFrame:
    return explode_computed(lines, keep, _classes(F.col(line), F.col(language), MALICIOUS), "_w").select(*keep, "_w.*")


def imports(lines: DataFrame, keep: Sequence[str], line: str = "line", language: str = "language") -> DataFrame:
    """Imported names per language and whether they are risky."""
    c, lang = F.trim(line), F.col(language)
    name = F.lit(None).cast("string")
    for language_name, patterns in IMPORTS.items():
        got = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])
        name = F.when(lang == language_name, got).otherwise(name)
    risky = F.lit(False)
    for language_name, words in RISKY_IMPORTS.items():
        risky = risky | ((lang == language_name) & contains_any(F.col("imported"), words))
    found = lines.select(*keep, language, name.alias("imported")).where(F.col("imported").isNotNull())
    return found.distinct().withColumn("risky", risky)


def is_comment(line: Column, language: Column) -> Column:
    def starts(marks):
        hit = F.lit(False)
        for m in marks:
            hit = hit | line.startswith(m)
        return hit

    out = starts(DEFAULT_COMMENTS)
    for name, marks in COMMENTS.items():
        out = F.when(language == name, starts(marks)).otherwise(out)
    return out


def line_metrics(lines: DataFrame, per: Sequence[str] = ("file_id",), line: str = "line", language: str = "language") -> DataFrame:
    stripped = F.regexp_replace(line, r"^\s+|\s+$", "")
    blank = stripped == ""
    comment = ~blank & is_comment(stripped, F.col(language))
    return lines.groupBy(*per).agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(blank).alias("blank_lines"), F.count_if(comment).alias("comment_lines"),
        F.count_if(~blank & ~comment).alias("code_lines"),
    )


def code_score(lines: DataFrame, per: str = "file_id", line: str = "line", language: str = "language") -> DataFrame:
    """Score 0-100 and risk band per file, from one pass over the lines."""
    c, lang = F.col(line), F.col(language)
    weak, bad = _classes(c, lang, WEAKNESSES), _classes(c, lang, MALICIOUS)
    skip = contains_any(c, SKIP_MARKS)
    found = F.when(skip, F.array().cast("array<struct<secret_type:string,masked_value:string,severity:string>>")).otherwise(
        F.concat(*[_secrets_of(c, n) for n in SECRETS])
    )
    critical = lambda a: F.size(F.filter(a, lambda x: x["severity"] == "critical"))
    counted = lines.select(
        per, line, language, F.size(weak).alias("w"), critical(weak).alias("wc"), F.size(found).alias("s"), critical(found).alias("sc"), F.size(bad).alias("m")
    )
    stripped = F.regexp_replace(line, r"^\s+|\s+$", "")
    comment = (stripped != "") & is_comment(stripped, lang)
    totals = counted.groupBy(per).agg(
        *[F.sum(n).alias(n) for n in ("w", "wc", "s", "sc", "m")], F.count_if(comment).alias("_comments"),
        F.count_if((stripped != "") & ~comment).alias("_code"),
    )
    score = (
        F.lit(100) - F.col("w") * 5 - F.col("wc") * 10 - F.col("s") * 3 - F.col("sc") * 7 - F.col("m") * 15
        + F.when(F.col("_comments") > F.col("_code") * 0.1, 5).otherwise(0)
    )
    serious, issues = F.col("wc") + F.col("sc") + F.col("m"), F.col("w") + F.col("s") + F.col("m")
    risk = (
        F.when((serious > 5) | (F.col("m") > 0), "CRITICAL").when((serious > 0) | (issues > 10), "HIGH").when(issues > 5, "MEDIUM")
        .when(issues > 0, "LOW").otherwise("SAFE")
    )
    return totals.select(
        per, F.col("w").alias("weaknesses"), F.col("s").alias("secrets"), F.col("m").alias("malicious"),
        F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("security_score"), risk.alias("risk"),
    )

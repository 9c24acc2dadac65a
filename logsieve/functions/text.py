"""Text classification and clean-up as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that decide a severity, tested in this order
SEVERITY_WORDS = {
    "critical": ("critical", "fatal", "emergency"),
    "high": ("error", "fail", "denied", "unauthorized"),
    "medium": ("warning", "warn", "alert"),
    "low": ("info", "information", "notice"),
}
OBJECT_SEVERITY_WORDS = {
    "critical": ("critical", "fatal", "emergency"),
    "high": ("error", "fail", "denied", "unauthorized"),
    "medium": ("warning", "warn"),
}
CSV_LEVEL_NAMES = {
    "critical": ("critical", "crit", "fatal", "emergency"),
    "high": ("high", "error", "err", "alert"),
    "medium": ("medium", "warning", "warn"),
    "info": ("low", "info", "information", "notice"),
}
CSV_SEVERITY_WORDS = {"high": ("fail", "error", "denied", "invalid"), "medium": ("warning", "warn")}

# fixed values: words that decide an event type, per kind of source
EVENT_TYPE_WORDS = {
    "text": {
        "error": ("error", "exception", "failed", "failure"),
        "warning": ("warning", "warn"),
        "authentication": ("auth", "login", "logon", "logoff"),
        "network": ("connect", "disconnect", "network"),
        "system": ("start", "stop", "restart", "boot"),
    },
    "json": {
        "error": ("error", "exception", "fail"),
        "authentication": ("auth", "login", "credential"),
        "network": ("network", "connection", "socket"),
        "file_operation": ("file", "directory", "path"),
        "process": ("process", "pid", "command"),
    },
    "csv": {
        "authentication": ("login", "password", "credential"),
        "network": ("network", "connection", "port"),
        "file_operation": ("file", "directory", "folder"),
    },
}
EVENT_TYPE_DEFAULT = {"text": "generic_log", "json": "generic_event", "csv": "generic_event"}
CSV_ACTION_WORDS = {
    "authentication": ("login", "logon", "auth"),
    "data_modification": ("create", "delete", "modify"),
    "network": ("connect", "disconnect"),
}

# fixed values: named patterns
SECURITY_PATTERNS = {
    "auth_failure": r"(?i)(authentication|login|access)\s+(failed|denied|rejected)",
    "permission_denied": r"(?i)permission\s+denied|access\s+denied|unauthorized",
    "sql_injection": r"(?i)(union\s+select|drop\s+table|exec\s*\(|script>|<script)",
    "path_traversal": r"\.\.[\\/]|\.\.%2[fF]",
    "command_injection": r"(?i);\s*(ls|cat|rm|del|cmd|powershell)",
}
URI_ATTACK_PATTERNS = {
    "sql_injection": r"(?i)(union|select|insert|update|delete|drop)[\s\+]+",
    "xss": r"(?i)<script|javascript:|onerror=|onload=",
    "path_traversal": r"\.\./|\.\.\\",
    "command_injection": r"(?i);\s*(cat|ls|pwd|whoami|id|uname)",
    "base64_encoded": r"^[A-Za-z0-9+/]{20,}={0,2}$",
    "suspicious_port": r"(4444|31337|12345|54321|1337|666|999)",
}
WEB_LOG_PATTERNS = {
    "sql_injection": r"(?i)(union.*select|select.*from|insert.*into|update.*set|delete.*from|drop.*table)",
    "xss": r"(?i)<script|javascript:|onerror=|onload=|onclick=",
    "path_traversal": r"\.\./|\.\.%2F|\.\.%5C",
}
OBFUSCATION_CALLS = {
    "eval usage": r"(?i)eval\s*\(",
    "exec usage": r"(?i)exec\s*\(",
    "character code conversion": r"(?i)String\.fromCharCode",
    "base64 decode": r"(?i)atob\s*\(",
    "unescape usage": r"(?i)unescape\s*\(",
    "template literal evaluation": r"\$\{.*\}",
}


def contains_any(col: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | col.contains(word)
    return found


def first_class(col: Column, classes: Mapping[str, Sequence[str]], default: str) -> Column:
    """Name of the first class one of whose words occurs in the (lower-cased) text."""
    lowered = F.lower(col)
    out = F.lit(default)
    for name, words in reversed(list(classes.items())):
        out = F.when(contains_any(lowered, words), name).otherwise(out)
    return out


def matched_names(col: Column, patterns: Mapping[str, str]) -> Column:
    """Names of all patterns found in the text, in the order given."""
    return F.array_compact(F.array(*[F.when(col.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def severity_from_message(col: Column) -> Column:
    return first_class(col, SEVERITY_WORDS, "info")


def severity_from_object(col: Column) -> Column:
    return first_class(col, OBJECT_SEVERITY_WORDS, "info")


def severity_from_csv(level: Column, row_text: Column) -> Column:
    """The level word when it is a known one, else what the row text says."""
    out = first_class(row_text, CSV_SEVERITY_WORDS, "info")
    lowered = F.lower(level)
    for name, words in reversed(list(CSV_LEVEL_NAMES.items())):
        out = F.when(lowered.isin(*words), name).otherwise(out)
    return out


def norm_severity(col: Column) -> Column:
    lowered = F.lower(col)
    return (
        F.when(lowered == "error", "high").when(lowered == "warning", "medium").when(lowered == "debug", "info")
        .otherwise(lowered)
    )


def guess_event_type(col: Column, flavour: str = "text", action: Column | None = None) -> Column:
    guess = first_class(col, EVENT_TYPE_WORDS[flavour], EVENT_TYPE_DEFAULT[flavour])
    if flavour == "csv" and action is not None:
        by_action = first_class(action, CSV_ACTION_WORDS, "")
        guess = F.when(F.coalesce(by_action, F.lit("")) != "", by_action).otherwise(guess)
    return guess


def security_indicators(col: Column) -> Column:
    return matched_names(col, SECURITY_PATTERNS)


def lifted_severity(severity: Column, indicators: Column) -> Column:
    return F.when(F.size(indicators) > 0, "high").otherwise(severity)


def uri_attack_flags(col: Column) -> Column:
    return matched_names(col, URI_ATTACK_PATTERNS)


def web_log_flags(col: Column) -> Column:
    return matched_names(col, WEB_LOG_PATTERNS)


def normalize_message(col: Column) -> Column:
    """Template of a message: timestamps dropped, UUIDs, IPs and digits replaced, 100 characters."""
    out = F.regexp_replace(col, r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", "")
    out = F.regexp_replace(out, r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "UUID")
    out = F.regexp_replace(out, r"\d+\.\d+\.\d+\.\d+", "IP")
    out = F.regexp_replace(out, r"\d+", "NUM")
    return F.substring(F.trim(F.lower(out)), 1, 100)


def log_pattern(fields: Mapping[str, Column]) -> Column:
    return F.concat_ws("|", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}:"), c)) for n, c in fields.items()])


# fixed values: substrings that mark an error
ERROR_WORDS = (
    "error", "fail", "denied", "reject", "unauthor", "forbidden", "invalid", "timeout", "exception",
)


def is_error(*fields: Column) -> Column:
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(contains_any(F.lower(field), ERROR_WORDS), F.lit(False))
    return hit


def string_entropy(col: Column) -> Column:
    """Shannon entropy in bits over the characters of a string."""
    n = F.length(col).cast("double")
    chars = F.array_distinct(F.split(col, ""))

    def term(total, ch):
        times = (F.length(col) - F.length(F.replace(col, ch, F.lit("")))).cast("double")
        return total - F.when(ch == "", 0.0).otherwise((times / n) * F.log2(times / n))

    return F.when(F.length(col) > 0, F.aggregate(chars, F.lit(0.0), term)).otherwise(F.lit(0.0))


def count_chars(col: Column, chars: str) -> Column:
    return F.length(col) - F.length(F.translate(col, chars, ""))


VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"


def is_dga_by_entropy(domain: Column) -> Column:
    """First label of 8-30 characters, more than 3.5 bits, under 30 % vowels."""
    label = F.split_part(domain, F.lit("."), F.lit(1))
    size = F.length(label)
    return (
        domain.contains(".")
        & size.between(8, 30)
        & (string_entropy(label) > 3.5)
        & (count_chars(label, VOWELS) / size < 0.3)
    )


def is_dga_by_consonants(domain: Column) -> Column:
    """Longer than 15 characters with over 75 % consonants."""
    size = F.length(domain)
    return (size > 15) & (count_chars(F.lower(domain), CONSONANTS) / size > 0.75)


def is_dga_by_label(domain: Column) -> Column:
    """Second-level label of 5-20 characters with few vowels or hardly a repeated character."""
    parts = F.split(domain, r"\.")
    label = F.lower(F.try_element_at(parts, F.lit(-2)))
    size = F.length(label)
    vowels = count_chars(label, VOWELS)
    distinct = F.size(F.array_distinct(F.split(label, "")))
    return F.coalesce(
        (F.size(parts) >= 2)
        & size.between(5, 20)
        & ((vowels == 0) | ((size - vowels) > 4 * vowels) | (distinct / size > 0.8)),
        F.lit(False),
    )


# fixed values: words and endings of phishing domains
PHISHING_WORDS = (
    "secure", "account", "verify", "update", "confirm", "paypal", "amazon", "microsoft", "google", "apple",
)
PHISHING_CONTEXT = (
    r"(?i)(secure|account|verify|update|confirm|banking|paypal|amazon|microsoft|google|apple)"
    r".*(\.tk|\.ml|\.ga|\.cf)"
)


def is_phishing_domain(domain: Column) -> Column:
    lowered = F.lower(domain)
    hit = F.lit(False)
    for word in PHISHING_WORDS:
        hit = hit | (lowered.contains(word) & ~lowered.endswith(f"{word}.com"))
    return hit


def is_phishing_context(domain: Column) -> Column:
    return domain.rlike(PHISHING_CONTEXT)


# fixed values: digest names by hexadecimal length, and prefixes of stored hashes
HASH_LENGTHS = {32: "md5", 40: "sha1", 56: "sha224", 64: "sha256", 96: "sha384", 128: "sha512"}
HASH_PREFIXES = {"$2a$": "bcrypt", "$2b$": "bcrypt", "$6$": "sha512crypt", "$5$": "sha256crypt", "$1$": "md5crypt"}


def hash_type(col: Column) -> Column:
    value = F.lower(F.trim(col))
    bare = F.regexp_replace(value, r"^0x", "")
    out = F.lit(None).cast("string")
    for prefix, name in HASH_PREFIXES.items():
        out = F.when(value.startswith(prefix), name).otherwise(out)
    for size, name in HASH_LENGTHS.items():
        out = F.when(bare.rlike(f"^[a-f0-9]{{{size}}}$"), name).otherwise(out)
    return out


# fixed values: shapes of stored password hashes
PASSWORD_HASH_SHAPES = (
    r"^\$2[aby]\$\d+\$",
    r"^\$argon2",
    r"^[a-fA-F0-9]{32}$",
    r"^[a-fA-F0-9]{40}$",
    r"^[a-fA-F0-9]{64}$",
    r"^\$\d+\$",
    r"^pbkdf2:",
)


def looks_like_password_hash(col: Column) -> Column:
    hit = F.lit(False)
    for shape in PASSWORD_HASH_SHAPES:
        hit = hit | col.rlike(shape)
    return hit


TRANSFORMS = {
    "upper": F.upper,
    "lower": F.lower,
    "md5": F.md5,
    "sha256": lambda c: F.sha2(c, 256),
    "base64": lambda c: F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", ""),
    "reverse": F.reverse,
    "length": lambda c: F.length(c).cast("string"),
}


def transform(col: Column, name: str) -> Column:
    return TRANSFORMS[name](col.cast("string"))


def mask_secret(col: Column) -> Column:
    """Keep four characters on each side of more than eight."""
    return _mask(col, 4, 8)


def mask_value(col: Column) -> Column:
    """Keep two characters on each side of more than four."""
    return _mask(col, 2, 4)


def _mask(col: Column, keep: int, over: int) -> Column:
    size = F.length(col)
    inner = F.repeat(F.lit("*"), size - 2 * keep)
    return F.when(size > over, F.concat(F.substring(col, 1, keep), inner, F.right(col, F.lit(keep)))).otherwise(
        F.repeat(F.lit("*"), size)
    )


def mask_username(col: Column) -> Column:
    """First and last character of the name are kept, and the domain of an address."""
    local = F.split_part(col, F.lit("@"), F.lit(1))
    hidden = F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.length(local) - 2), F.right(local, F.lit(1)))
    masked = F.when(F.length(local) > 2, hidden).otherwise(F.repeat(F.lit("*"), F.length(local)))
    domain = F.split_part(col, F.lit("@"), F.lit(2))
    return F.when(col.contains("@"), F.concat(masked, F.lit("@"), domain)).otherwise(masked)


def obfuscation_flags(col: Column) -> Column:
    """Signs of encoding and of calls that unpack code."""
    size = F.length(col)

    def over_a_tenth(ch):
        return (size - F.length(F.replace(col, F.lit(ch), F.lit("")))) > size * 0.1

    return F.array_compact(
        F.array(
            F.when(col.rlike(r"^[A-Za-z0-9+/]{20,}={0,2}$"), F.lit("base64")),
            F.when(col.rlike(r"^[0-9a-fA-F\s]{20,}$"), F.lit("hex_encoding")),
            F.when(over_a_tenth("%"), F.lit("url_encoding")),
            F.when(col.rlike(r"\\u[0-9a-fA-F]{4}"), F.lit("unicode_escape")),
            F.when(over_a_tenth("\\"), F.lit("excessive_escaping")),
            *[F.when(col.rlike(p), F.lit(n)) for n, p in OBFUSCATION_CALLS.items()],
        )
    )


def clean_text(col: Column) -> Column:
    """Drop control and format characters except newline and tab, fold white space."""
    printable = F.regexp_replace(col, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    return F.trim(F.regexp_replace(printable, r"\s+", " "))


# fixed values: brands imitated by look-alike characters, and those characters
HOMOGRAPH_BRANDS = ("google", "microsoft", "apple", "amazon", "paypal", "ebay")
HOMOGRAPH_CHARS = ("0", "1", "l", "3", "@", "5", "$", "9")


def is_homograph(domain: Column) -> Column:
    mixed = domain.rlike("[\u0430-\u044f\u0410-\u042f]") & domain.rlike("[a-zA-Z]")
    return mixed | (contains_any(domain, HOMOGRAPH_BRANDS) & contains_any(domain, HOMOGRAPH_CHARS))

"""Yes/no tests over canonical events.

Each test takes the columns it may look at; a column the data does not have is passed
as None and counts as absent. Nulls never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import contains_any

# fixed values
FAILED_RESULTS = ("failed", "failure", "denied")
SUCCESS_RESULTS = ("success", "successful", "granted")
LOGIN_ACTIONS = ("login", "logon", "authentication")
ACCESS_TYPES = ("access", "file_access", "resource_access")
ACCESS_ACTIONS = ("access", "read", "open")
SENSITIVE_WORDS = (
    "sensitive", "confidential", "secret", "password", "credential", "private", "admin", "config",
)
CONFIG_WORDS = ("config", "conf", "settings", "ini", "cfg")
LARGE_TRANSFER_BYTES = 100_000_000


class EventFields:
    """Access to the fields of an event table by name, null where there is no such column."""

    def __init__(self, df: DataFrame | list[str]):
        self.columns = set(df if isinstance(df, list) else df.columns)

    def text(self, name: str) -> Column:
        column = F.col(name).cast("string") if name in self.columns else F.lit(None).cast("string")
        return F.coalesce(column, F.lit(""))

    def low(self, name: str) -> Column:
        return F.lower(self.text(name))

    def flag(self, name: str) -> Column:
        return self.low(name) == "true"

    def number(self, name: str) -> Column:
        return F.coalesce(self.text(name).try_cast("double"), F.lit(0.0))

    def is_login(self) -> Column:
        return (
            (self.text("event_type") == "login")
            | self.text("action").isin(*LOGIN_ACTIONS)
            | self.low("message").contains("login")
        )

    def is_failed_login(self) -> Column:
        return self.is_login() & (
            self.text("result").isin(*FAILED_RESULTS)
            | self.text("status").isin(*FAILED_RESULTS)
            | self.low("message").contains("fail")
        )

    def is_successful_login(self) -> Column:
        message = self.low("message")
        return self.is_login() & (
            self.text("result").isin(*SUCCESS_RESULTS)
            | self.text("status").isin(*SUCCESS_RESULTS)
            | (message.contains("success") & ~message.contains("fail"))
        )

    def is_access(self) -> Column:
        return (
            self.text("event_type").isin(*ACCESS_TYPES)
            | self.text("action").isin(*ACCESS_ACTIONS)
            | self.low("message").contains("access")
        )

    def is_privileged(self) -> Column:
        return (
            self.flag("privileged")
            | self.flag("elevation")
            | contains_any(self.low("user"), ("admin", "root"))
            | self.low("command").contains("sudo")
        )

    def is_suspicious_access(self) -> Column:
        hit = F.lit(False)
        for name in ("file", "resource", "path", "target"):
            hit = hit | contains_any(self.low(name), SENSITIVE_WORDS)
        return hit

    def is_large_transfer(self, over: float = LARGE_TRANSFER_BYTES) -> Column:
        hit = F.lit(False)
        for name in ("bytes", "bytes_sent", "bytes_transferred", "size"):
            hit = hit | (self.number(name) > over)
        return hit

    def is_service_modification(self) -> Column:
        return (
            (self.text("event_type") == "service")
            | self.text("action").isin("service_create", "service_modify", "service_delete")
            | (
                self.low("target").contains("service")
                & self.text("action").isin("create", "modify", "delete", "change")
            )
        )

    def is_elevated_process(self) -> Column:
        return (self.text("event_type") == "process") & (
            self.flag("elevated")
            | self.text("integrity_level").isin("high", "system")
            | self.low("user").contains("admin")
        )

    def is_registry_change(self) -> Column:
        return (
            (self.text("event_type") == "registry")
            | self.low("target").contains("registry")
            | self.text("action").isin("registry_set", "registry_delete", "registry_create")
        )

    def is_unusual_login(self) -> Column:
        return self.is_login() & (
            self.flag("anomaly")
            | self.flag("unusual")
            | (self.number("risk_score") > 70)
            | self.low("message").contains("unusual")
        )

    def is_config_change(self) -> Column:
        return (
            (self.text("event_type") == "config")
            | self.text("action").isin("config_change", "settings_modified")
            | contains_any(self.low("file"), CONFIG_WORDS)
        )

    def is_sensitive_access(self) -> Column:
        return self.is_access() & self.is_suspicious_access()


def event_id(ts: Column, event_type: Column, source: Column, target: Column) -> Column:
    parts = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.coalesce(event_type, F.lit("unknown"))]
    return F.md5(F.concat_ws("|", *parts, F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))))


def describe_event(fields: EventFields) -> Column:
    """One sentence per event type."""
    known = lambda n: F.when(fields.text(n) == "", "unknown").otherwise(fields.text(n))
    kind = known("event_type")
    target = F.when(fields.text("target") != "", fields.text("target")).otherwise(fields.text("destination"))
    generic = F.concat_ws(
        " ",
        kind,
        F.when(fields.text("action") != "", fields.text("action")),
        F.when(fields.text("source") != "", F.concat(F.lit("from "), fields.text("source"))),
        F.when(target != "", F.concat(F.lit("to "), target)),
    )
    return (
        F.when(kind == "login", F.concat(F.lit("Login by "), known("user"), F.lit(" from "), known("source")))
        .when(
            kind == "network",
            F.concat(F.lit("Network connection from "), known("source"), F.lit(" to "), known("destination")),
        )
        .when(kind == "process", F.concat(F.lit("Process "), known("process"), F.lit(" started by "), known("user")))
        .when(kind == "file", F.concat(F.lit("File operation on "), known("file"), F.lit(" by "), known("user")))
        .otherwise(generic)
    )

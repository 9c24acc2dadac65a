"""Sensitive columns and suspicious values in any set of tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import looks_like_password_hash, mask_value

# fixed values: words of column names by words of table names
SENSITIVE = {
    "users": ("password", "email", "username", "ssn", "credit_card"),
    "accounts": ("account_number", "routing_number", "balance", "pin"),
    "auth": ("token", "session", "api_key", "secret"),
    "cookies": ("value", "host_key", "encrypted_value"),
    "credentials": ("username", "password", "key", "secret"),
    "messages": ("content", "body", "from", "to"),
    "history": ("url", "title", "visit_count"),
    "downloads": ("url", "path", "referrer"),
    "config": ("value", "setting", "parameter"),
    "logs": ("message", "data", "payload"),
}
# fixed values: patterns of values, tested in this order
VALUE_PATTERNS = {
    "c2_urls": r"https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "base64_payload": r"[A-Za-z0-9+/]{50,}={0,2}",
    "obfuscated": r"\\x[0-9a-fA-F]{2}",
    "suspicious_domains": r"\.(?:tk|ml|ga|cf|bit|onion|i2p)\b",
    "crypto_wallet": r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[a-fA-F0-9]{40}",
}
CRITICAL_VALUES = ("c2_urls", "crypto_wallet")
BANDS = ((100, "CRITICAL"), (50, "HIGH"), (20, "MEDIUM"))


def _cells(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, value) rows of the chosen columns, read once."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.lit(table).alias("table"), F.explode(cells).alias("_c")).select("table", "_c.*").where("value IS NOT NULL AND value <> ''")


def sensitive_columns(tables: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) pairs whose names speak of sensitive data; only schemas are looked at."""
    found = []
    for table, df in tables.items():
        for word, columns in SENSITIVE.items():
            if word in table.lower():
                found += [(table, c) for c in df.columns if any(s in c.lower() for s in columns)]
    return list(dict.fromkeys(found))


def sensitive_data(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """Per sensitive column: values, severity, tag and a masked sample; plain-text passwords are told apart."""
    pairs = sensitive_columns(tables)
    if not pairs:
        return None
    per_table: dict[str, list[str]] = {}
    for table, column in pairs:
        per_table.setdefault(table, []).append(column)
    cells = reduce(DataFrame.unionByName, [_cells(tables[t], t, cs) for t, cs in per_table.items()])
    low = F.lower("column")
    is_password, is_card, is_ssn = low.contains("password"), low.contains("credit") | low.contains("card"), low.contains("ssn")
    plain = F.count_if(is_password & ~looks_like_password_hash(F.col("value")))
    return cells.groupBy("table", "column").agg(
        F.count(F.lit(1)).alias("values"), plain.alias("plaintext"), mask_value(F.min("value")).alias("masked_sample")
    ).select(
        "table", "column", "values", "masked_sample",
        F.when(is_password | is_card | is_ssn, "critical").otherwise("warning").alias("severity"),
        F.when(is_password & (F.col("plaintext") > 0), "plaintext_password").when(is_password, "password").when(is_card, "payment_card")
        .when(is_ssn, "ssn").otherwise("sensitive").alias("tag"),
    )


def suspicious_values(tables: Mapping[str, DataFrame], first_columns: int | None = None) -> DataFrame:
    """Cells with a suspicious pattern, counted per table, column and pattern."""
    parts = []
    for table, df in tables.items():
        columns = [name for name, kind in df.dtypes if kind in ("string", "binary")][:first_columns]
        if columns:
            parts.append(_cells(df, table, columns))
    cells = reduce(DataFrame.unionByName, parts)
    pattern = F.lit(None).cast("string")
    for name, regex in reversed(list(VALUE_PATTERNS.items())):
        pattern = F.when(F.col("value").rlike(regex), name).otherwise(pattern)
    hits = cells.withColumn("pattern", pattern).where(F.col("pattern").isNotNull())
    return hits.groupBy("table", "column", "pattern").agg(F.count(F.lit(1)).alias("hits")).withColumn(
        "severity", F.when(F.col("pattern").isin(*CRITICAL_VALUES), "critical").otherwise("warning")
    )


def table_risk(sensitive: DataFrame | None, suspicious: DataFrame) -> DataFrame:
    """One row: points for plain-text passwords, sensitive columns and suspicious cells, and a band."""
    from logsieve.operators.stats import with_scalars

    bad = suspicious.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("suspicious_values"))
    if sensitive is not None:
        kept = sensitive.agg(
            F.count(F.lit(1)).alias("sensitive_columns"), F.coalesce(F.max((F.col("tag") == "plaintext_password").cast("int")), F.lit(0)).alias("_plain")
        )
        bad = with_scalars(bad, kept)
    else:
        bad = bad.withColumns({"sensitive_columns": F.lit(0), "_plain": F.lit(0)})
    score = F.col("_plain") * 50 + F.col("sensitive_columns") * 2 + F.col("suspicious_values") * 5
    band = F.when(F.col("risk_score") > 0, "LOW").otherwise("SECURE")
    for bound, label in reversed(BANDS):
        band = F.when(F.col("risk_score") >= bound, label).otherwise(band)
    return bad.withColumn("risk_score", score).withColumn("risk", band).drop("_plain")

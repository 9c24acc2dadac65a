"""Registered queries: a DataFrame builder over the benchmark tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import importlib

from logsieve.queries.registry import ORACLE, QUERIES

MODULES = (
    "scalars", "timing", "buckets", "fanout", "series", "indicators", "intel", "rules", "patterns", "correlation",
    "attack", "reports", "history", "readers", "network", "cloud", "mobile", "mail", "code", "hosts", "similarity",
    "density", "streams",
)


# a literal such as 0.9 is a decimal number in SQL and a double in Spark
DECIMAL_CONFIDENCE = (
    "url_intel", "domain_verdicts", "dga_dns_queries", "match_feed", "sigma_match", "sigma_aggregates", "sigma_consolidated",
    "signature_match", "behavioural_indicators", "map_iocs", "map_behaviours", "map_signatures", "map_sigma", "map_tools",
    "technique_scores", "tactic_chain", "file_inventory",
)


def _as_double(sql: str) -> str:
    return f"SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({sql})"


def load_all() -> tuple[dict, dict]:
    """(queries, their SQL)."""
    for name in MODULES:
        importlib.import_module(f"logsieve.queries.{name}")
    return QUERIES, {n: _as_double(sql) if n in DECIMAL_CONFIDENCE else sql for n, sql in ORACLE.items()}

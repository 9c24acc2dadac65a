"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Registers a query with its SQL, under a second name too if it has one."""

    def keep(fn):
        for own in filter(None, (name, also)):
            if own in QUERIES:
                raise ValueError(f"query {own} is registered twice")
            QUERIES[own] = fn
            if sql is not None:
                ORACLE[own] = sql
        return fn

    return keep

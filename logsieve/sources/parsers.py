"""Parsers that a user brings: table functions in Python, called from SQL and from DataFrames.

A parser is a class whose `eval(self, text)` yields tuples, none where it cannot read the text. Rows travel in Arrow
batches. Formats that Spark's own functions can read need no parser; `operators/rules.register_extractor` takes Columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Parser:
    """name: also the name in SQL. schema: of the rows it yields. suffixes: of the files it is meant for, in lower case."""

    name: str
    handler: type
    schema: str
    suffixes: Sequence[str] = ()

    def function(self):
        return F.udtf(self.handler, returnType=self.schema, useArrow=True)


PARSERS: dict[str, Parser] = {}


def register_parser(spark: SparkSession, parser: Parser) -> None:
    """Makes the parser known by its name, here and as a table function of the session's SQL."""
    spark.udtf.register(parser.name, parser.function())
    PARSERS[parser.name] = parser


def parse_with(df: DataFrame, name: str, text: str) -> DataFrame:
    """The rows of df, each with what the parser yields for its text: one row per tuple.

    Rows for which it yields nothing are left out. The parser's columns must not be named like those of df.
    """
    parser = PARSERS.get(name)
    if parser is None:
        raise ValueError(f"no parser is registered as {name}")
    rows = parser.function()(F.col(f"`{text}`").outer())
    clash = sorted({c.lower() for c in df.columns} & {c.lower() for c in StructType.fromDDL(parser.schema).names})
    if clash:
        raise ValueError(f"the parser and the table both have {', '.join(clash)}")
    return df.lateralJoin(rows)


def _has_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | F.endswith(path, F.lit(suffix.lower()))
    return found


def parse_files(lines: DataFrame, path: str, text: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """By parser the rows of its files, and under "text" the rows that no parser is meant for.

    The first of `names` whose suffix a file's path has reads it; paths are compared in lower case, a null path belongs to
    none. Each result has the columns of `lines` and those of its parser.
    """
    file = F.lower(F.coalesce(F.col(f"`{path}`"), F.lit("")))
    free = F.lit(True)
    out = {}
    for name in names:
        if name not in PARSERS:
            raise ValueError(f"no parser is registered as {name}")
        own = _has_suffix(file, PARSERS[name].suffixes)
        out[name] = parse_with(lines.where(free & own), name, text)
        free = free & ~own
    out["text"] = lines.where(free)
    return out

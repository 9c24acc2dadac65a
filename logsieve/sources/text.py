"""Plain-text logs: known line shapes, stack traces, and lines without a shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import text as txt
from logsieve.functions.clock import normalize_timestamp
from logsieve.operators.ordered import with_carry
from logsieve.sources.lines import read_lines

# fixed values: shapes of a line, tested in this order
ISO = r"^(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(.*)$"
SYSLOG = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)?\s*(.*)$"
ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\S+)'
JAVA = r"^([\w\.]+Exception(?::|$))\s*(.*)?$"
PYTHON = r"^Traceback\s+\(most recent call last\):$"
SHAPES = {
    "iso_timestamp": ISO, "syslog_like": SYSLOG, "access_log": ACCESS, "java_exception": JAVA, "python_traceback": PYTHON,
}
JAVA_START, JAVA_MORE = r"^[\w\.]+Exception(?::|$)", r"^\s+at\s+[\w\.\$]+"
PYTHON_START, PYTHON_MORE = PYTHON, r'^(?:\s+File\s+"|(?:\s+)?[\w\.]+Error:)'
CHUNK_LINES = 10_000
MAX_LINES = {"java_stacktrace": 50, "python_traceback": 30}  # limits that `stitch_multiline` can be given
# fixed values: timestamps anywhere in a line
LOOSE_TIMESTAMPS = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}",
    r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})",
)
SHOWN = 200


def shape_of(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(SHAPES.items())):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def find_timestamp(line: Column, year: int | None = None) -> Column:
    """The first timestamp found anywhere in a line."""
    found = [
        F.regexp_extract(line, p, 1 if "(" in p.replace("(?", "") else 0) for p in LOOSE_TIMESTAMPS
    ]
    return F.coalesce(*[F.when(f != "", normalize_timestamp(F.regexp_replace(f, r"^(\d{4}-\d{2}-\d{2})\s", "$1 "), year)) for f in found])


def parse_lines(lines: DataFrame, line: str = "line", year: int | None = None) -> DataFrame:
    """Non-blank lines as entries; a line without a known shape is kept as unstructured."""
    c = F.col(line)
    shaped = lines.where(F.trim(F.regexp_replace(c, r"\s", " ")) != "").withColumn("pattern_type", shape_of(c))
    kind = F.col("pattern_type")
    is_ = lambda name: kind == name
    pick = lambda pattern, group: F.regexp_extract(c, pattern, group)
    content = F.when(is_("iso_timestamp"), pick(ISO, 2)).when(is_("syslog_like"), pick(SYSLOG, 3)).otherwise(c)
    exception = F.regexp_replace(pick(JAVA, 1), ":$", "")
    message = (
        F.when(is_("access_log"), F.concat(pick(ACCESS, 3), F.lit(" "), pick(ACCESS, 4), F.lit(" - "), pick(ACCESS, 6)))
        .when(is_("java_exception"), F.concat(exception, F.lit(": "), pick(JAVA, 2)))
        .when(kind.isNull(), F.substring(c, 1, SHOWN))
        .otherwise(content)
    )
    event_type = (
        F.when(is_("access_log"), "web_access").when(is_("java_exception"), "application_error")
        .when(is_("syslog_like"), "system_log").when(kind.isNotNull(), "generic_log").otherwise(txt.guess_event_type(c, "text"))
    )
    source = (
        F.when(is_("access_log"), pick(ACCESS, 1)).when(is_("java_exception"), "application")
        .when(is_("syslog_like"), pick(SYSLOG, 2)).otherwise("text_file")
    )
    plain = (
        F.when(is_("access_log"), F.when(pick(ACCESS, 6).rlike("^[45]"), "high").otherwise("info"))
        .when(is_("java_exception"), "high").otherwise(txt.severity_from_message(content))
    )
    indicators = txt.security_indicators(c)
    ts = (
        F.when(is_("iso_timestamp"), normalize_timestamp(pick(ISO, 1)))
        .when(is_("syslog_like"), normalize_timestamp(pick(SYSLOG, 1), year))
        .when(is_("access_log"), normalize_timestamp(pick(ACCESS, 2)))
        .when(kind.isNull(), find_timestamp(c, year))
    )
    return shaped.select(
        *[x for x in lines.columns if x != line],
        ts.alias("ts"),
        source.alias("source"),
        event_type.alias("event_type"),
        txt.lifted_severity(plain, indicators).alias("severity"),
        message.alias("message"),
        c.alias("raw_data"),
        kind,
        kind.isNull().alias("unstructured"),
        indicators.alias("security_indicators"),
    )


def access_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fields of access-log lines; other lines are left out."""
    c = F.col(line)
    pick = lambda group: F.regexp_extract(c, ACCESS, group)
    return lines.where(c.rlike(ACCESS)).select(
        *[x for x in lines.columns if x != line],
        pick(1).alias("ip"), normalize_timestamp(pick(2)).alias("ts"), pick(3).alias("method"), pick(4).alias("path"),
        pick(5).alias("protocol"), pick(6).cast("int").alias("status"), pick(7).try_cast("long").alias("size"),
        F.when(pick(6).rlike("^[45]"), "high").otherwise("info").alias("severity"),
    )


def stitch_multiline(
    lines: DataFrame, file: str = "file_id", number: str = "line_no", line: str = "line", max_lines: Mapping[str, int] | None = None,
) -> DataFrame:
    """Stack traces as one entry each: a start line and all continuation lines right after it.

    With `max_lines` (such as MAX_LINES) a trace ends after so many lines of its kind. The last line that does not go on with a trace is
    looked for in the line's own chunk of the file; what chunks hand over is one row each.
    """
    c = F.col(line)
    start = F.when(c.rlike(JAVA_START), "java_stacktrace").when(c.rlike(PYTHON_START), "python_traceback")
    more = F.when(c.rlike(JAVA_MORE), "java_stacktrace").when(c.rlike(PYTHON_MORE), "python_traceback")
    flagged = lines.select(
        file, number, line, start.alias("_start"), F.when(start.isNull(), more).alias("_more"), F.floor(F.col(number) / CHUNK_LINES).alias("_chunk")
    )
    # a line belongs to a trace when the last line that does not go on with that kind of trace opened one
    opener = F.struct(F.col(number).alias("at"), F.col("_start").alias("kind"))
    others = {k: F.when(F.coalesce(F.col("_more") != k, F.lit(True)), opener) for k in MAX_LINES}
    earlier = W.partitionBy(file).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = with_carry(
        flagged, [file], "_chunk", {f"_last_{k}": F.max(o) for k, o in others.items()}, {f"_before_{k}": F.last(f"_last_{k}", ignorenulls=True).over(earlier) for k in MAX_LINES}
    )
    here = W.partitionBy(file, "_chunk").orderBy(number).rowsBetween(W.unboundedPreceding, 0)
    framed = carried.withColumns({f"_open_{k}": F.coalesce(F.last(o, ignorenulls=True).over(here), F.col(f"_before_{k}")) for k, o in others.items()})
    kind, block = F.col("_start"), F.when(F.col("_start").isNotNull(), F.col(number))
    for k in MAX_LINES:
        goes_on = (F.col("_more") == k) & (F.col(f"_open_{k}.kind") == k)
        kind = F.when(goes_on, F.lit(k)).otherwise(kind)
        block = F.when(goes_on, F.col(f"_open_{k}.at")).otherwise(block)
    inside = framed.select(file, number, line, kind.alias("kind"), block.alias("block")).where(kind.isNotNull())
    for k, limit in (max_lines or {}).items():
        inside = inside.where((F.col("kind") != k) | (F.col(number) - F.col("block") < limit))
    blocks = inside.groupBy(file, "block", "kind").agg(
        F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct(F.col(number), F.col(line)))).alias("_rows")
    )
    texts = F.transform("_rows", lambda r: r[line])
    errors = F.filter(texts, lambda t: t.contains("Error:"))
    message = F.when(
        F.col("kind") == "java_stacktrace",
        F.concat(F.lit("Java Exception: "), F.regexp_extract(F.element_at(texts, 1), r"^([\w\.]+Exception)", 1)),
    ).otherwise(F.coalesce(F.try_element_at(errors, F.lit(-1)), F.lit("Python Traceback")))
    return blocks.select(
        file,
        F.col("block").alias("line_no"),
        F.when(F.col("kind") == "java_stacktrace", "java_exception").otherwise("python_exception").alias("event_type"),
        F.lit("high").alias("severity"),
        message.alias("message"),
        "lines",
        F.array_join(texts, "\n").alias("raw_data"),
    )


def read_text_logs(spark: SparkSession, path: str | list[str], year: int | None = None) -> DataFrame:
    return parse_lines(read_lines(spark, path), year=year)

"""Timestamps, buckets, durations and relative-time tests as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import bind

# fixed values: accepted formats and the shape a text must have before one is tried, in this order
TIMESTAMP_FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", r"^\d{4}-\d{2}-\d{2}T[\d:]{8}\.\d{6}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T[\d:]{8}$"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", r"^\d{4}-\d{2}-\d{2} [\d:]{8}\.\d{6}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} [\d:]{8}$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} [\d:]{8}$"),
    ("dd/MM/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} [\d:]{8}$"),
    ("MM/dd/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} [\d:]{8}$"),
    ("dd/MMM/yyyy:HH:mm:ss Z", r"^\d{2}/[A-Za-z]{3}/\d{4}:[\d:]{8} [+-]\d{4}$"),
    ("dd/MMM/yyyy:HH:mm:ss", r"^\d{2}/[A-Za-z]{3}/\d{4}:[\d:]{8}$"),
    ("dd-MMM-yyyy HH:mm:ss", r"^\d{2}-[A-Za-z]{3}-\d{4} [\d:]{8}$"),
    ("MM/dd/yyyy hh:mm:ss a", r"^\d{2}/\d{2}/\d{4} [\d:]{8} [AaPp][Mm]$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("MM-dd-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
)
ISO_LIKE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})?$"
SYSLOG_LIKE = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"
# fixed values: zone abbreviations
TIME_ZONES = {
    "EST": "US/Eastern", "EDT": "US/Eastern", "CST": "US/Central", "CDT": "US/Central", "MST": "US/Mountain",
    "MDT": "US/Mountain", "PST": "US/Pacific", "PDT": "US/Pacific", "GMT": "UTC", "BST": "Europe/London",
}


def normalize_timestamp(col: Column, year: int | None = None) -> Column:
    """Text or epoch number to a timestamp; null when nothing fits.

    The text is bound first: a filter on the result is pushed below the projection, where
    an unbound text would be computed again for every format.
    """

    def read(text: Column) -> Column:
        iso = F.when(text.rlike(ISO_LIKE), text.try_cast("timestamp"))
        number = F.when(text.rlike(r"^\d{9,19}(\.\d+)?$"), text.try_cast("double"))
        epoch = (
            F.when(number >= 1e17, F.timestamp_micros((number / 1e3).cast("long")))
            .when(number >= 1e14, F.timestamp_micros(number.cast("long")))
            .when(number >= 1e11, F.timestamp_millis(number.cast("long")))
            .otherwise(F.timestamp_seconds(number))
        )
        # a parser is only called on text of its shape: a failed call costs far more than a match
        parsed = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in TIMESTAMP_FORMATS]
        candidates = [iso, epoch, *parsed]
        if year is not None:
            folded = F.concat(F.lit(f"{year} "), F.regexp_replace(text, r"\s+", " "))
            candidates.append(F.when(text.rlike(SYSLOG_LIKE), F.try_to_timestamp(folded, F.lit("yyyy MMM d HH:mm:ss"))))
        return F.coalesce(*candidates)

    return bind(F.trim(col.cast("string")), read)


def to_utc(ts: Column, zone: Column) -> Column:
    """Local time of a named zone or abbreviation to UTC."""
    pairs = [F.lit(x) for pair in TIME_ZONES.items() for x in pair]
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(zone)), zone)
    return F.to_utc_timestamp(ts, name)


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket of the given width, as a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def bucket_spine(bounds: DataFrame, start: str, end: str, seconds: int, name: str = "bucket") -> DataFrame:
    """All bucket starts between two times, per row of `bounds`."""
    first = time_bucket(F.col(start), seconds)
    last = time_bucket(F.col(end), seconds)
    step = F.make_dt_interval(secs=F.lit(float(seconds)))
    return bounds.select("*", F.explode(F.sequence(first, last, step)).alias(name))


def is_business_hours(ts: Column, start: int = 9, end: int = 17) -> Column:
    return F.dayofweek(ts).between(2, 6) & (F.hour(ts) >= start) & (F.hour(ts) < end)


DURATION_UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


def parse_duration(col: Column) -> Column:
    """`1d 2h 3m 4s` to seconds; null when there is no unit at all."""
    text = F.lower(col)
    total = F.lit(0).cast("long")
    for unit, seconds in DURATION_UNITS.items():
        amount = F.regexp_extract(text, rf"(\d+)\s*{unit}", 1).try_cast("long")
        total = total + F.coalesce(amount, F.lit(0)) * seconds
    return F.when(text.rlike(r"\d+\s*[dhms]"), total)


def format_duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    parts = {
        "d": F.floor(whole / 86400),
        "h": F.floor(whole % 86400 / 3600),
        "m": F.floor(whole % 3600 / 60),
        "s": whole % 60,
    }
    text = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for u, v in parts.items()])
    return F.when(text == "", "0s").otherwise(text)


def _seconds_before(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6


def within_last(ts: Column, seconds: float, as_of: Column) -> Column:
    return F.coalesce(_seconds_before(ts, as_of) <= seconds, F.lit(False))


def older_than(ts: Column, seconds: float, as_of: Column) -> Column:
    return F.coalesce(_seconds_before(ts, as_of) > seconds, F.lit(False))


def between_times(ts: Column, start: str, end: str) -> Column:
    """Time of day inside [start, end]; a range over midnight is allowed."""
    clock = F.date_format(ts, "HH:mm")
    if start <= end:
        hit = clock.between(start, end)
    else:
        hit = (clock >= start) | (clock <= end)
    return F.coalesce(hit, F.lit(False))


def is_recent(ts: Column, as_of: Column, hours: float = 24) -> Column:
    return within_last(ts, hours * 3600, as_of)

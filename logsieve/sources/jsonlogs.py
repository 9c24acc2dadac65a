"""JSON logs: arrays, envelopes, single objects or JSON lines, and four dialects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import text as txt
from logsieve.functions.clock import normalize_timestamp
from logsieve.functions.rows import explode_computed
from logsieve.sources.jsonsplit import read_json_records
from logsieve.sources.lines import read_lines

# fixed values: names of fields, tried in this order
ENVELOPES = ("records", "events", "logs", "data", "items", "entries", "results")
TIMESTAMP_FIELDS = (
    "timestamp", "time", "datetime", "date", "created_at", "updated_at", "@timestamp", "eventTime", "event_time",
    "log_time", "occurred_at",
)
SOURCE_FIELDS = (
    "source", "src", "host", "hostname", "computer", "device", "source_ip", "src_ip", "client", "origin", "sender",
)
MESSAGE_FIELDS = (
    "message", "msg", "text", "description", "details", "content", "event", "action", "summary", "log", "data",
)
IMPORTANT = r"(?i)event|action|method|status|result"
SHOWN = 200


def field(obj: Column, name: str) -> Column:
    return F.get_json_object(obj, f"$['{name}']")


def _strings(array: Column) -> Column:
    """JSON array text to an array of the texts of its elements."""
    return F.from_json(array, "array<string>")


def objects(df: DataFrame, text: str = "text", keep: Sequence[str] = ("file_id",)) -> DataFrame:
    """One row per record of a JSON text: array elements, the list inside an envelope, or the object itself."""
    t = F.trim(F.col(text))
    listed = [F.when(F.startswith(field(t, e), F.lit("[")), field(t, e)) for e in ENVELOPES]
    keys = F.json_object_keys(t)
    only = F.when(F.size(keys) == 1, F.map_values(F.from_json(t, "map<string,string>"))[0])
    sole = F.when(F.startswith(only, F.lit("[")), only)
    records = (
        F.when(t.startswith("["), _strings(t))
        .when(t.startswith("{"), F.coalesce(_strings(F.coalesce(*listed, sole)), F.array(t)))
    )
    return explode_computed(df, keep, records, "object")


def parsed(obj: Column) -> Column:
    """The top-level fields of a record as texts, from one pass over it; inner objects stay JSON."""
    return F.from_json(obj, "map<string,string>")


def has(fields: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, F.lit(name)), F.lit(False))


def value(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def dialect(fields: Column) -> Column:
    return (
        F.when(has(fields, "eventTime") & has(fields, "eventName") & has(fields, "eventSource"), "cloudtrail")
        .when(has(fields, "_source") | has(fields, "@timestamp"), "elasticsearch")
        .when(has(fields, "_time") & has(fields, "_raw"), "splunk")
        .otherwise("generic")
    )


def first_field(fields: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[value(fields, n) for n in names])


def built_message(fields: Column) -> Column:
    """Up to five fields that speak of events, actions or results; else the first three."""
    pairs = F.map_entries(fields)
    scalar = F.filter(pairs, lambda p: ~p["key"].startswith("_") & ~p["value"].rlike(r"^[\[{]"))
    show = lambda rows, n: F.array_join(F.transform(F.slice(rows, 1, n), lambda p: F.concat(p["key"], F.lit("="), p["value"])), " | ")
    important = F.filter(scalar, lambda p: p["key"].rlike(IMPORTANT))
    rest = show(F.filter(F.slice(pairs, 1, 3), lambda p: ~p["value"].rlike(r"^[\[{]")), 3)
    return F.when(F.size(important) > 0, show(important, 5)).when(rest != "", rest).otherwise("JSON object")


def metadata(obj: Column, max_fields: int = 10) -> Column:
    """Scalars, small scalar lists, and the fields of small inner objects as `outer.inner`."""
    top = F.from_json(obj, "map<string,string>")
    flat = F.map_filter(top, lambda k, v: ~v.startswith("{") & (~v.startswith("[") | (F.size(_strings(v)) < max_fields) & ~v.contains("{")))
    inner = F.filter(F.map_entries(top), lambda e: e["value"].startswith("{"))
    nested = F.flatten(
        F.transform(
            F.filter(inner, lambda e: F.size(F.from_json(e["value"], "map<string,string>")) < max_fields),
            lambda e: F.transform(
                F.filter(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda p: ~p["value"].startswith("{")),
                lambda p: F.struct(F.concat(e["key"], F.lit("."), p["key"]).alias("key"), p["value"].alias("value")),
            ),
        )
    )
    return F.map_concat(flat, F.map_from_entries(nested))


def json_entries(df: DataFrame, obj: str = "object", keep: Sequence[str] = ("file_id",)) -> DataFrame:
    """JSON records as entries, each by its dialect."""
    outer = df.select(*keep, F.col(obj).alias("_o"), parsed(F.col(obj)).alias("_f")).withColumn("dialect", dialect(F.col("_f")))
    d = F.col("dialect")
    # documents of a search index carry the record inside
    inside = (d == "elasticsearch") & value(F.col("_f"), "_source").isNotNull()
    staged = outer.withColumn("_i", F.when(inside, value(F.col("_f"), "_source")).otherwise(F.col("_o"))).withColumn(
        "_g", F.when(inside, parsed(F.col("_i"))).otherwise(F.col("_f"))
    )
    top, raw, rec, text = F.col("_f"), F.col("_o"), F.col("_g"), F.col("_i")
    cloud = d == "cloudtrail"
    splunk = d == "splunk"
    name = F.coalesce(value(top, "eventName"), F.lit("Unknown"))
    who = value(top, "userIdentity")
    identity = F.coalesce(F.get_json_object(who, "$.userName"), F.get_json_object(who, "$.arn"), F.lit("Unknown"))
    raw_text = F.coalesce(value(top, "_raw"), F.lit(""))
    ts = (
        F.when(cloud, normalize_timestamp(value(top, "eventTime"))).when(splunk, normalize_timestamp(value(top, "_time")))
        .otherwise(F.coalesce(*[F.when(has(rec, n), normalize_timestamp(value(rec, n))) for n in TIMESTAMP_FIELDS]))
    )
    source = (
        F.when(cloud, F.coalesce(value(top, "eventSource"), F.lit("aws")))
        .when(splunk, F.coalesce(value(top, "source"), F.lit("splunk")))
        .otherwise(F.coalesce(first_field(rec, SOURCE_FIELDS), F.lit("json_file")))
    )
    message = (
        F.when(cloud, F.concat(F.lit("AWS "), name, F.lit(" by "), identity))
        .when(splunk, F.substring(raw_text, 1, SHOWN))
        .otherwise(F.coalesce(first_field(rec, MESSAGE_FIELDS), built_message(rec)))
    )
    severity = (
        F.when(
            cloud,
            F.when(F.coalesce(value(top, "errorCode"), F.lit("")) != "", "high")
            .when(F.lower(name).rlike("^(create|delete|modify)"), "medium").otherwise("info"),
        )
        .when(splunk, txt.severity_from_message(raw_text))
        .otherwise(txt.severity_from_object(text))
    )
    event_type = F.when(cloud, "cloud_audit").when(splunk, "log_aggregation").otherwise(txt.guess_event_type(text, "json"))
    index = F.when(
        d == "elasticsearch",
        F.create_map(F.lit("es_index"), value(top, "_index"), F.lit("es_type"), value(top, "_type"), F.lit("es_id"), value(top, "_id")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return staged.select(
        *keep, "dialect", ts.alias("ts"), source.alias("source"), event_type.alias("event_type"), severity.alias("severity"),
        message.alias("message"), raw.alias("raw_data"),
        F.map_concat(metadata(text), F.map_filter(index, lambda k, v: v.isNotNull())).alias("metadata"),
    )


def read_json_logs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of JSON files, split at any size; `lines=True` takes each line for itself, which needs no scan."""
    if lines:
        numbered = read_lines(spark, path).select("file_id", F.col("line").alias("text"))
        return json_entries(objects(numbered))
    return json_entries(read_objects(spark, path))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, object): the records of JSON files of any shape, read by split (`jsonsplit`)."""
    elements, texts = read_json_records(spark, path, ENVELOPES)
    return elements.unionByName(objects(texts))

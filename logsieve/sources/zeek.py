"""Network-sensor logs: tab-separated with a header of types, or JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.net import SENSOR_PORTS, lookup
from logsieve.functions.text import contains_any, is_dga_by_label, uri_attack_flags

TYPES = {"time": "double", "interval": "double", "double": "double", "int": "long", "count": "long", "port": "int", "bool": "boolean"}
# fixed values: first fields of each kind of log
KIND_FIELDS = {
    "conn": ("proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state"),
    "http": ("trans_depth", "method", "host", "uri"),
    "dns": ("trans_id", "query", "qtype_name", "rcode_name"),
    "ssl": ("cipher", "server_name", "validation_status"),
    "files": ("fuid", "tx_hosts", "rx_hosts", "mime_type"),
    "notice": ("note", "msg", "sub"),
}
CONN_STATES = {
    "S0": "Connection attempt seen, no reply", "S1": "Connection established, not terminated",
    "SF": "Normal establishment and termination", "REJ": "Connection attempt rejected",
    "S2": "Connection established and close attempt by originator seen",
    "S3": "Connection established and close attempt by responder seen",
    "RSTO": "Connection established, originator aborted", "RSTR": "Responder sent a RST",
    "RSTOS0": "Originator sent a SYN then RST", "RSTRH": "Responder sent a RST in response to SYN",
    "SH": "Originator sent a SYN then FIN", "SHR": "Responder sent a SYN ACK then FIN",
    "OTH": "No SYN seen, just midstream traffic",
}
REJECTED = ("REJ", "RSTR", "RSTOS0", "RSTRH")
EXECUTABLE_TYPES = (
    "application/x-dosexec", "application/x-executable", "application/x-mach-binary", "application/x-elf",
)
EXECUTABLE_ENDINGS = (".exe", ".dll", ".scr", ".vbs", ".js", ".jar", ".bat", ".cmd", ".ps1", ".hta")
WEAK_TLS = ("SSLv2", "SSLv3", "TLSv10", "TLSv11")
LARGE_FILE = 100 * 1024 * 1024
DNS_TLDS = (".tk", ".ml", ".ga", ".cf")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _names, _types) of each file with a line of field names: what stands after `#fields` and `#types`."""
    lines = spark.read.text(path).where("value LIKE '#fields%' OR value LIKE '#types%'")

    def rest(mark: str) -> Column:
        return F.max(F.when(F.col("value").startswith(mark + "\t"), F.substring("value", len(mark) + 2, 2**31 - 1)))

    found = lines.groupBy(F.col("_metadata.file_path").alias("_file")).agg(rest("#fields").alias("_names"), F.coalesce(rest("#types"), F.lit("")).alias("_types"))
    return found.where(F.col("_names").isNotNull())


def log_kind(fields: Sequence[str], path: str = "") -> str:
    """Kind of log by its fields, else by its file name."""
    best = max(KIND_FIELDS, key=lambda k: sum(f in fields for f in KIND_FIELDS[k]))
    if sum(f in fields for f in KIND_FIELDS[best]) >= 2:
        return best
    return next((k for k in KIND_FIELDS if k in path.rsplit("/", 1)[-1]), "unknown")


def read_zeek(spark: SparkSession, path: str, json_lines: bool = False, kind: str | None = None) -> DataFrame:
    """The logs under a path, each by the header of its own file, cast by their declared types; `-` and nothing are null.

    Logs of several kinds give the columns of all, null where a log has no such field; with `kind` only the files of that
    kind are read. A field declared with different types stays a string. A file without a line of field names gives no
    rows. The different headers, one or a few a kind, come to the driver; the headers of the files are joined to the lines.
    """
    if json_lines:
        return spark.read.json(path)
    headers = read_headers(spark, path)
    shapes = [(r["_names"], r["_types"]) for r in headers.select("_names", "_types").distinct().orderBy("_names", "_types").collect()]
    shapes = [(n, t) for n, t in shapes if kind is None or log_kind(n.split("\t")) == kind]
    if not shapes:
        raise ValueError(f"no log{f' of kind {kind}' if kind else ''} with a line of field names under {path}")
    places: dict[str, list[tuple[int, int]]] = {}
    declared: dict[str, set[str]] = {}
    for k, (names, types) in enumerate(shapes):
        types = types.split("\t")
        for i, name in enumerate(names.split("\t")):
            places.setdefault(name, []).append((k, i))
            declared.setdefault(name, set()).add(types[i] if i < len(types) else "string")
    which = F.coalesce(*[F.when((F.col("_names") == n) & (F.col("_types") == t), F.lit(k)) for k, (n, t) in enumerate(shapes)])
    wanted = headers.select("_file", which.alias("_shape")).where(F.col("_shape").isNotNull())
    lines = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")
    parts = lines.select(F.col("_metadata.file_path").alias("_file"), F.split("value", "\t").alias("_parts")).join(wanted, "_file")
    out = []
    for name, at in places.items():
        text = F.coalesce(*[F.when(F.col("_shape") == k, F.get("_parts", F.lit(i))) for k, i in at])
        column = F.when(~text.isin("-", ""), text)
        (of, *more) = declared[name]
        if not more and of == "bool":
            column = F.upper(column) == "T"
        elif not more and of in TYPES:
            column = column.try_cast(TYPES[of])
        out.append(column.alias(name))
    return parts.select(*out)


def pick(df: DataFrame, name: str, kind: str = "string", default=None) -> Column:
    """A field under its dotted or underscored name, or a default where the log has none."""
    for candidate in (name, name.replace(".", "_")):
        if candidate in df.columns:
            column = F.col(f"`{candidate}`").cast(kind)
            return F.coalesce(column, F.lit(default)) if default is not None else column
    return F.lit(default).cast(kind)


def _ends(df: DataFrame) -> list[Column]:
    return [
        pick(df, "uid", default="").alias("uid"),
        F.timestamp_seconds(pick(df, "ts", "double")).alias("ts"),
        pick(df, "id.orig_h", default="").alias("source_ip"),
        pick(df, "id.orig_p", "int", 0).alias("source_port"),
        pick(df, "id.resp_h", default="").alias("dest_ip"),
        pick(df, "id.resp_p", "int", 0).alias("dest_port"),
    ]


def _flags(*named: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in named]))


def conn_flags(state: Column, source_port: Column, dest_port: Column) -> tuple[Column, Column]:
    """(severity, suspicious) of a connection."""
    odd = F.coalesce(source_port.isin(*SENSOR_PORTS), F.lit(False)) | F.coalesce(dest_port.isin(*SENSOR_PORTS), F.lit(False))
    severity = F.when(odd | F.coalesce(state.isin(*REJECTED), F.lit(False)), "warning").otherwise("info")
    return severity, _flags((odd, "suspicious_port"))


def conn(df: DataFrame) -> DataFrame:
    state = pick(df, "conn_state", default="")
    severity, flags = conn_flags(state, pick(df, "id.orig_p", "int", 0), pick(df, "id.resp_p", "int", 0))
    return df.select(
        F.lit("connection").alias("log_type"), *_ends(df), pick(df, "proto", default="").alias("protocol"),
        pick(df, "service", default="").alias("service"), pick(df, "duration", "double", 0.0).alias("duration"),
        pick(df, "orig_bytes", "long", 0).alias("orig_bytes"), pick(df, "resp_bytes", "long", 0).alias("resp_bytes"),
        pick(df, "orig_pkts", "long", 0).alias("orig_pkts"), pick(df, "resp_pkts", "long", 0).alias("resp_pkts"),
        state.alias("conn_state"), F.coalesce(lookup(state, CONN_STATES), F.lit("")).alias("conn_state_desc"),
        severity.alias("severity"), flags.alias("suspicious"),
    )


def http_flags(uri: Column, status: Column, username: Column, password: Column) -> tuple[Column, Column]:
    exposed = (F.coalesce(username, F.lit("")) != "") | (F.coalesce(password, F.lit("")) != "")
    flags = F.concat(F.when(F.coalesce(uri, F.lit("")) != "", uri_attack_flags(uri)).otherwise(F.array().cast("array<string>")), _flags((exposed, "credentials_exposed")))
    severity = (
        F.when(exposed, "high").when(F.size(flags) > 0, "warning").when(status >= 500, "error")
        .when(status >= 400, "warning").otherwise("info")
    )
    return severity, flags


def http(df: DataFrame) -> DataFrame:
    severity, flags = http_flags(
        pick(df, "uri", default=""), pick(df, "status_code", "int", 0), pick(df, "username", default=""), pick(df, "password", default="")
    )
    return df.select(
        F.lit("http").alias("log_type"), *_ends(df),
        *[pick(df, n, default="").alias(n) for n in ("method", "host", "uri", "referrer", "user_agent", "username")],
        pick(df, "status_code", "int", 0).alias("status_code"), severity.alias("severity"), flags.alias("suspicious"),
    )


def dns_flags(name: Column, qtype: Column, rcode: Column) -> tuple[Column, Column]:
    dga = is_dga_by_label(name)
    bad_tld = contains_any(F.lower(name), DNS_TLDS)
    tunnel = (qtype == "TXT") & (F.length(name) > 100)
    failed = (rcode != "") & (rcode != "NOERROR")
    severity = F.when(tunnel, "high").when(dga | bad_tld | failed, "warning").otherwise("info")
    return severity, _flags((dga, "possible_dga"), (~dga & bad_tld, "suspicious_tld"), (tunnel, "possible_dns_exfiltration"))


def dns(df: DataFrame) -> DataFrame:
    name, qtype, rcode = (pick(df, n, default="") for n in ("query", "qtype_name", "rcode_name"))
    severity, flags = dns_flags(name, qtype, rcode)
    return df.select(
        F.lit("dns").alias("log_type"), *_ends(df), name.alias("query"), qtype.alias("qtype_name"), rcode.alias("rcode_name"),
        pick(df, "answers").alias("answers"), severity.alias("severity"), flags.alias("suspicious"),
    )


def tls_flags(version: Column, status: Column) -> tuple[Column, Column]:
    weak = version.isin(*WEAK_TLS)
    own = F.lower(status).contains("self signed")
    failed = (status != "") & (status != "ok")
    severity = F.when(failed, "high").when(weak | own, "warning").otherwise("info")
    return severity, _flags((weak, "weak_tls_version"), (own, "self_signed_cert"), (failed, "cert_validation_failed"))


def tls(df: DataFrame) -> DataFrame:
    version, status = pick(df, "version", default=""), pick(df, "validation_status", default="")
    severity, flags = tls_flags(version, status)
    return df.select(
        F.lit("ssl").alias("log_type"), *_ends(df), version.alias("version"), status.alias("validation_status"),
        *[pick(df, n, default="").alias(n) for n in ("cipher", "server_name", "subject", "issuer")],
        severity.alias("severity"), flags.alias("suspicious"),
    )


def file_flags(mime: Column, name: Column, size: Column) -> tuple[Column, Column]:
    executable = mime.isin(*EXECUTABLE_TYPES)
    ending = F.lit(False)
    for e in EXECUTABLE_ENDINGS:
        ending = ending | F.lower(name).endswith(e)
    large = size > LARGE_FILE
    flags = _flags((executable, "executable_file"), (ending, "suspicious_extension"), (large, "large_file_transfer"))
    return F.when(F.size(flags) > 0, "warning").otherwise("info"), flags


def files(df: DataFrame) -> DataFrame:
    mime, name, size = pick(df, "mime_type", default=""), pick(df, "filename", default=""), pick(df, "total_bytes", "long", 0)
    severity, flags = file_flags(mime, name, size)
    return df.select(
        F.lit("file").alias("log_type"), F.timestamp_seconds(pick(df, "ts", "double")).alias("ts"),
        *[pick(df, n, default="").alias(n) for n in ("fuid", "source", "md5", "sha1", "sha256")],
        mime.alias("mime_type"), name.alias("filename"), size.alias("total_bytes"), severity.alias("severity"), flags.alias("suspicious"),
    )


def host_and_port(value: Column) -> tuple[Column, Column]:
    host = F.split_part(value, F.lit(":"), F.lit(1))
    port = F.split_part(value, F.lit(":"), F.lit(2)).try_cast("int")
    return F.when(value.contains(":"), host).otherwise(value), F.when(value.contains(":"), port)


def notice(df: DataFrame) -> DataFrame:
    src_host, src_port = host_and_port(pick(df, "src", default=""))
    dst_host, dst_port = host_and_port(pick(df, "dst", default=""))
    return df.select(
        F.lit("notice").alias("log_type"), pick(df, "uid", default="").alias("uid"),
        F.timestamp_seconds(pick(df, "ts", "double")).alias("ts"),
        *[pick(df, n, default="").alias(n) for n in ("note", "msg", "sub")], src_host.alias("source_ip"), src_port.alias("source_port"),
        dst_host.alias("dest_ip"), dst_port.alias("dest_port"), F.lit("high").alias("severity"),
        F.array().cast("array<string>").alias("suspicious"),
    )


PROJECTIONS = {"conn": conn, "http": http, "dns": dns, "ssl": tls, "files": files, "notice": notice}


def read_zeek_typed(spark: SparkSession, path: str, kind: str | None = None, json_lines: bool = False) -> DataFrame:
    """The rows of one kind of log; the kind must be named where a path holds several."""
    if kind is None and not json_lines:
        kinds = {log_kind(r["_names"].split("\t")) for r in read_headers(spark, path).select("_names").distinct().collect()}
        if len(kinds) > 1:
            raise ValueError(f"logs of several kinds under {path}, name one: {sorted(kinds)}")
        raw = read_zeek(spark, path)
        return PROJECTIONS[log_kind(raw.columns, path)](raw)
    raw = read_zeek(spark, path, json_lines, kind)
    return PROJECTIONS[kind or log_kind(raw.columns, path)](raw)

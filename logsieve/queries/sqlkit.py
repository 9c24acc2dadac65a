"""Pieces of SQL shared by the comparison queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from logsieve.adapt import HISTORY_TECHNIQUES, MESSAGE_TEMPLATES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(template: str) -> str:
    parts = {
        "u": "CAST(user_id AS VARCHAR)",
        "k": "CAST(k AS VARCHAR)",
        "k2": "lpad(CAST(k AS VARCHAR), 2, '0')",
        "md5": "md5(CAST(user_id AS VARCHAR))",
        "priv": "'10.0.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR)",
        "pub": "'203.0.113.' || CAST(k AS VARCHAR)",
    }
    pieces = []
    for chunk in template.split("{"):
        if "}" in chunk:
            name, rest = chunk.split("}", 1)
            pieces.append(parts[name])
            if rest:
                pieces.append(text(rest))
        elif chunk:
            pieces.append(text(chunk))
    return " || ".join(pieces)


_MESSAGE = "CASE " + " ".join(f"WHEN k % 20 = {i} THEN {_filled(t)}" for i, t in enumerate(MESSAGE_TEMPLATES)) + " END"

CTES = {
    "log_events": """
        SELECT event_id, ts, epoch_us(ts) AS us, 'user_' || user_id AS source, 'user_' || user_id AS "user",
               event_type, event_type AS action,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS result, value AS bytes,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    "messages": f"""
        SELECT CAST(event_id AS VARCHAR) AS entry_id, user_id AS file_id, event_id AS line_no, ts, epoch_us(ts) AS us,
               'host-' || (user_id % 16) AS source, 'user_' || user_id AS "user", event_type, k,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, {_MESSAGE} AS message
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "entries": """
        SELECT doc_id || ':' || line_no AS entry_id, doc_id AS file_id, line_no,
               make_timestamp(CAST((1704067200 + doc_id * 37 + line_no) * 1000000 AS BIGINT)) AS ts,
               (1704067200 + doc_id * 37 + line_no) * 1000000 AS us, source, message
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS message,
                     unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)""",
    "flows": """
        SELECT l_orderkey || ':' || l_linenumber AS flow_id, o_custkey AS src, l_suppkey AS dst, l_partkey AS dst_port,
               CAST(l_extendedprice AS DOUBLE) AS bytes, CAST(l_quantity AS DOUBLE) AS packets, l_shipdate AS ts,
               epoch_us(l_shipdate) AS us, l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "geo_events": """
        SELECT o_custkey AS "user", n_name AS country, l_shipdate AS ts, epoch_us(l_shipdate) AS us,
               l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey""",
    "metrics": """
        SELECT event_type AS metric, ts, epoch_us(ts) AS us, value, event_id FROM events""",
    "history": f"""
        SELECT doc_id AS id, 'file_' || doc_id || '.log' AS file_name, source AS file_type, n_chars AS file_size,
               sha256(text) AS file_hash,
               make_timestamp(CAST((1704067200 + (doc_id % 60) * 86400 + doc_id % 86400) * 1000000 AS BIGINT))
                   AS analysis_date,
               CAST(doc_id % 101 AS INTEGER) AS threat_score,
               CASE WHEN doc_id % 101 >= 75 THEN 'critical' WHEN doc_id % 101 >= 50 THEN 'high'
                    WHEN doc_id % 101 >= 25 THEN 'medium' ELSE 'low' END AS severity,
               CAST(doc_id % 7 AS INTEGER) AS iocs_found,
               list_slice([{', '.join(text(t) for t in HISTORY_TECHNIQUES)}], 1, doc_id % 15 % 6) AS mitre_techniques,
               [lang] AS tags, '' AS notes
        FROM documents""",
}


CTES["corpus"] = f"""
        SELECT entry_id, 'user-' || file_id AS file_id, message FROM ({CTES['messages']}) UNION ALL
        SELECT 'p' || page_id, 'page-' || page_id, url FROM pages UNION ALL
        SELECT 'h' || page_id, 'page-' || page_id, html FROM pages UNION ALL
        SELECT entry_id, 'document-' || file_id, message FROM ({CTES['entries']})"""

# \\b of RE2 knows ASCII only: letters and digits outside ASCII become a word character,
# everything else outside ASCII a blank
GUARDED = r"regexp_replace(regexp_replace(message, '[^\x00-\x7F\P{L}]', '_', 'g'), '[^\x00-\x7F]', ' ', 'g')"


#: a source of `find_all` over the corpus
CORPUS_TEXTS = f"c AS (SELECT entry_id, file_id, message AS t, {GUARDED} AS g FROM corpus)"


def find_all(source: str, patterns: Mapping[str, str], keep: Sequence[str], lowered: Sequence[str] = (), guarded: str = "t") -> str:
    """Rows (keep..., kind, ioc_value), one per distinct match of a pattern in `t` of a row of `source`.

    Patterns that begin at a word's border match ASCII only and look into `guarded`.
    """
    cols = ", ".join(keep)
    parts = []
    for kind, pattern in patterns.items():
        value = "lower(m)" if kind in lowered else "m"
        column = guarded if pattern.startswith(r"\b") else "t"
        parts.append(
            f"SELECT {cols}, '{kind}' AS kind, {value} AS ioc_value FROM (SELECT {cols}, "
            f"unnest(list_distinct(regexp_extract_all({column}, {text(pattern)}))) AS m FROM {source})"
        )
    return " UNION ALL ".join(parts)


def with_ctes(names: str | Sequence[str], body: str) -> str:
    """WITH the named tables, then `body`, which may go on with its own CTEs (`, x AS (...) SELECT`)."""
    if isinstance(names, str):
        names = names.split()
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    joint = "" if body.lstrip().startswith(",") else "\n"
    return f"WITH {head}{joint}{body}"


def has_any(column: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def first_class(column: str, classes: Mapping[str, Sequence[str]], default: str) -> str:
    whens = " ".join(f"WHEN {has_any(f'lower({column})', words)} THEN {text(n)}" for n, words in classes.items())
    return f"CASE {whens} ELSE {text(default)} END"


def matched(column: str, patterns: Mapping[str, str]) -> str:
    """Comma-separated names of the patterns found."""
    parts = ", ".join(f"CASE WHEN regexp_matches({column}, {text(p)}) THEN {text(n)} END" for n, p in patterns.items())
    return f"concat_ws(',', {parts})"


def values(rows: Sequence[Sequence], *columns: str) -> str:
    """A table of fixed rows."""

    def one(v):
        if v is None:
            return "NULL"
        return text(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"

"""The driver contract on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_point  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SAMPLE = [
    "error_rate_spikes", "rapid_fire", "burst", "impossible_travel", "trend_change", "extract_iocs", "match_feed", "sigma_match", "custom_match",
    "signature_match", "behavioural_indicators", "lateral_movement", "data_exfiltration", "graph_pivots", "attack_chains", "technique_scores",
    "threat_scores", "history_counts", "json_entries", "stitch_multiline", "sensor_dns", "cloud_rapid_calls", "phishing_score", "code_score",
    "near_duplicates", "cluster_noise", "extract_file_paths", "extract_advanced_corpus", "extract_more_kinds", "ioc_summary", "map_iocs",
]


def test_registry_is_consistent():
    queries, oracle = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 200


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import duckdb
    from check import TABLES, norm

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    expected = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == expected


def test_whole_corpus_has_page_sources_and_all_kinds(spark):
    import re

    import pyarrow.parquet as pq

    from logsieve.operators import ioc

    queries = entry_point.queries()
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()

    def brute(kind):
        return {(f"h{r['page_id']}", m[0]) for r in pages for m in re.finditer(ioc.BASIC_PATTERNS[kind], r["html"] or "", re.ASCII)}

    paths = queries["extract_file_paths"](spark, SF)
    assert {(r.entry_id, r.ioc_value) for r in paths.where("entry_id like 'h%'").collect()} == brute("files")
    found = {(r.ioc_type, r.ioc_value) for r in queries["extract_iocs"](spark, SF).where("ioc_type in ('files', 'emails')").collect()}
    assert {(kind, v) for kind in ("files", "emails") for _, v in brute(kind)} <= found and brute("files")
    assert "files" in {r.ioc_type for r in queries["ioc_summary"](spark, SF).collect()}
    assert {"email", "unix_path"} <= {r.kind for r in queries["extract_advanced_corpus"](spark, SF).select("kind").distinct().collect()}

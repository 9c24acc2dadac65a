"""Similar sets and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.operators import overlap, similarity
from logsieve.operators.timing import rounded
from logsieve.queries.registry import query


PAIRS_SQL = r"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\f\r\x0B]+'), lambda x: x <> '') AS ws FROM documents WHERE trim(text) <> ''),
    sh AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')))) AS ss FROM w),
    st AS (SELECT ss, min(doc_id) AS head, count(*) AS members FROM sh GROUP BY 1), t AS (SELECT head, members, len(ss) AS size, unnest(ss) AS x FROM st),
    p AS (SELECT a.head AS first_key, b.head AS second_key, a.members AS first_members, b.members AS second_members, count(*) / (a.size + b.size - count(*)) AS sim
          FROM t a JOIN t b ON a.x = b.x AND a.head < b.head GROUP BY a.head, b.head, a.members, b.members, a.size, b.size),
    p2 AS (SELECT * FROM p WHERE sim > 0.5)"""


@query("near_duplicates", f"WITH {PAIRS_SQL} SELECT first_key, second_key, first_members, second_members, round(sim, 6) AS similarity FROM p2")
def near_duplicates(spark, sf_dir):
    pairs, _ = similarity.near_duplicates(adapt.spread(adapt.table(spark, sf_dir, "documents")), "doc_id", "text", over=0.5)
    return rounded(pairs)


@query(
    "near_duplicate_classes",
    f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT first_key AS u, second_key AS v FROM p2 UNION ALL SELECT second_key, first_key FROM p2),
    r AS (SELECT head AS node, head AS seen FROM st UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen),
    c AS (SELECT node, min(seen) AS class_id FROM r GROUP BY 1)
    SELECT doc_id, node AS set_id, class_id FROM sh JOIN st USING (ss) JOIN c ON c.node = st.head""",
)
def near_duplicate_classes(spark, sf_dir):
    """Every document with its class of near copies."""
    return similarity.near_duplicate_classes(adapt.spread(adapt.table(spark, sf_dir, "documents")), "doc_id", "text", over=0.5)


@query(
    "set_overlap_pairs",
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 64 AS t FROM lineitem), sz AS (SELECT s, count(*) AS n, string_agg(t, ',' ORDER BY t) AS sig FROM e GROUP BY 1),
    h AS (SELECT sig, min(s) AS head, any_value(n) AS n FROM sz GROUP BY 1), x AS (SELECT head, n, t FROM h JOIN e ON e.s = head),
    p AS (SELECT a.head AS ka, b.head AS kb, count(*) / (a.n + b.n - count(*)) AS sim FROM x a JOIN x b ON a.t = b.t AND a.head < b.head GROUP BY 1, 2, a.n, b.n)
    SELECT ka, kb, round(sim, 6) AS similarity FROM p WHERE sim > 0.8""",
)
def set_overlap_pairs(spark, sf_dir):
    rows = adapt.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 64).alias("t"))
    pairs, _ = overlap.set_overlap_pairs(rows, "l_suppkey", "t", 0.8)
    return rounded(pairs.select(F.col("a_set").alias("ka"), F.col("b_set").alias("kb"), "similarity"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return overlap.duplicate_keys(adapt.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "missing_values",
    "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)",
)
def missing_values(spark, sf_dir):
    """Parts that were shipped but never sent back in bulk."""
    rows = adapt.table(spark, sf_dir, "lineitem")
    return overlap.missing_values(rows, rows.where("l_returnflag = 'R' AND l_quantity > 30"), "l_partkey")


@query(
    "connected_components",
    "SELECT user_id AS node, min(user_id % 7) AS component FROM events GROUP BY 1",
)
def connected_components(spark, sf_dir):
    """Users linked in chains of step seven: the component is the user number modulo seven."""
    users = adapt.table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    edges = users.where("u >= 7").select("u", (F.col("u") - 7).alias("v"))
    return overlap.connected_components(edges)

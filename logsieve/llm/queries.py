"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from logsieve.llm import ball_codes, chat, gap_packing, language_model, line_dedup, manifest, ngram_join, packing, pieces, pii, quality, token_counts, vector_dedup
from logsieve.llm.store import fresh_path

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, window=1024)


def _quality_sql(false_rejection: float = 0.03, risk: float = 0.05) -> str:
    """The rules of `quality` in SQL, certified together along their path; P(X <= k) summed over all terms."""
    rules, rate = quality.RULES, false_rejection
    tests = ", ".join(f"('{r.name}', {j}, {r.cutoffs[at[i]]}::DOUBLE)" for j, at in enumerate(quality.joint_path(rules)) for i, r in enumerate(rules))
    values = " UNION ALL ".join(f"SELECT doc_id, lang, '{r.name}' AS rule, ({r.measure.replace('/', '::DOUBLE /')})::DOUBLE AS value FROM m WHERE NOT base_failed" for r in rules)
    return rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
    g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY 1),
    ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
    m0 AS (SELECT t.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_exclaim
      FROM t JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
    m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
    v AS ({values}),
    good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
    c(rule, step, cutoff) AS (VALUES {tests}),
    n AS (SELECT lang, count(*) AS n FROM m JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY 1),
    o AS (SELECT DISTINCT v.lang, v.doc_id, step FROM v JOIN good USING (doc_id) JOIN c USING (rule) WHERE value > cutoff),
    k AS (SELECT n.lang, s.step, n.n, count(o.doc_id) AS k FROM n CROSS JOIN (SELECT DISTINCT step FROM c) s LEFT JOIN o ON o.lang = n.lang AND o.step = s.step GROUP BY 1, 2, 3),
    p AS (SELECT *, CASE WHEN k >= n * {rate} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) END AS p FROM k),
    f AS (SELECT lang, max(step) FILTER (ok) AS step FROM (SELECT *, bool_and(p <= {risk} / (SELECT count(*) FROM n)) OVER (PARTITION BY lang ORDER BY step) AS ok FROM p) GROUP BY 1),
    bad AS (SELECT DISTINCT doc_id FROM v JOIN f USING (lang) JOIN c USING (rule, step) WHERE value > cutoff)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""


@query("op3_quality_rules", _quality_sql())
def op3_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    "op6_line_dedup",
    r"""WITH w AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS white),
    t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM t),
    k AS (SELECT doc_id, place, line, translate(trim(line, (SELECT white FROM w)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, place, line, coalesce(f.last <> k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1""",
)
def op6_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "token-counts"), TOKENIZER)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op4_pii")
def op4_pii(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [pii.count_of(F.col("pii_spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("pii_spans")).alias("spans"), pii.scores_text(F.col("pii_spans")).alias("scores"))


@query("op8_ngram_join")
def op8_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), width=5, percent=75)


@query("op1_vector_dedup")
def op1_vector_dedup(spark, sf_dir):
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


MARKED = r"</s>[INST] ok [/INST]"


@query(
    "op5_chat_format",
    r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + list_sum(list_transform(['<|turn|>', '<|end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
      lambda k: (length(text) - length(replace(text, k, ''))) // length(k))) AS escaped FROM c),
    t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length('<|turn|>') + length(role) + 1 + escaped + length('<|end|>') + 1) AS formatted_chars FROM e GROUP BY 1)
    SELECT conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM t""",
)
def op5_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    template = chat.Template()
    return chat.read_back(chat.format_conversations(rows.unionByName(added), template), template).drop("valid")


@query("op9_lm_scores")
def op9_lm_scores(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents")).drop("bits_per_byte")


@query("op7_piece_encoding")
def op7_piece_encoding(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), path, dropout=0.1, seed=11)
    read = pieces.decode(encoded, path)
    return read.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query("op11_gap_packing")
def op11_gap_packing(spark, sf_dir):
    return gap_packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, window=2048)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _manifest_sql() -> str:
    """The tree by recursion over levels; CRC-32 of the id bit by bit."""
    coded = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(coded.format(f) for f in FIELDS) + ")"
    bits = "list_reduce(list_concat([xor(c, ch)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, ch: {bits}), 4294967295)"

    def tree(name: str) -> str:
        """Nodes of all levels, and per lowest node its steps, from leaves `name`(tree, i, h)."""
        return f"""{name}_n(tree, lvl, i, h, n) AS (SELECT tree, 0, i, h, count(*) OVER (PARTITION BY tree) FROM {name}
      UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name}_n WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
    {name}_s AS (SELECT tree, lvl, i, h, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
      coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}_n WINDOW w AS (PARTITION BY tree, lvl, i // 3 ORDER BY i)),
    {name}_p AS (SELECT l.tree, l.i, list({{'b': s.b, 'a': s.a}} ORDER BY s.lvl) AS steps FROM {name} l
      JOIN {name}_s s ON s.tree = l.tree AND s.i = l.i // pow(3, s.lvl)::BIGINT AND s.n > 1 GROUP BY 1, 2),
    {name}_r AS (SELECT tree, h FROM {name}_n WHERE n = 1)"""

    return f"""WITH RECURSIVE d AS (SELECT *, {leaf} AS h, {leaf.replace("text", "replace(text, chr(10), '')")} AS h2, coalesce({crc} % 2 = 0, false) AS odd FROM documents),
    g AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
    lf AS (SELECT doc_id, h, CASE WHEN odd THEN h2 ELSE h END AS t, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    {tree("lf")},
    tp AS (SELECT 0 AS tree, tree AS i, h FROM lf_r),
    {tree("tp")},
    e AS (SELECT lf.doc_id, lf.h AS leaf, lf.t, lf_r.h AS subroot, (SELECT h FROM tp_r) AS root, list_concat(coalesce(lf_p.steps, []), coalesce(tp_p.steps, [])) AS steps
      FROM lf JOIN lf_r USING (tree) LEFT JOIN lf_p USING (tree, i) LEFT JOIN tp_p ON tp_p.i = lf.tree)
    SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(steps, lambda s: s.b || s.a)), 'string_agg', '')) AS proof_sha256,
      list_reduce(list_concat([{{'b': t, 'a': ''}}], steps), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}).b AS folded_root, folded_root = root AS verified FROM e"""


@query("op12_manifest", _manifest_sql())
def op12_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(f) for f in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, manifest.row_digest([*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    rows = manifest.manifest(docs, FIELDS, carry=[changed]).withColumn("folded_root", manifest.fold(F.coalesce("carried_0", "leaf"), F.col("steps")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _codes_sql(rounds: int = 4) -> str:
    """The rounds written out; every part is compared with every entry."""

    def assigned(k: int) -> str:
        squared = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, x, min(e) AS e, min(d) AS d FROM (SELECT p.*, b.e, {squared} AS d, min({squared}) OVER (PARTITION BY vec_id, p.part) AS least
      FROM p JOIN b{k} b ON b.part = p.part) WHERE d = least GROUP BY 1, 2, 3)"""

    def moved(k: int) -> str:
        return f"""u{k} AS (SELECT part, e, list(m::BIGINT ORDER BY i) AS x FROM (SELECT part, e, i, floor(sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END) AS m
      FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(u.x, b.x) AS x FROM b{k} b LEFT JOIN u{k} u USING (part, e))"""

    turns = ", ".join(f"{assigned(k)}, {moved(k)}" for k in range(rounds))
    return f"""WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
    p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM q, (SELECT unnest(range(4)) AS part)),
    b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < 256),
    {turns}, {assigned(rounds)},
    s AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{rounds})),
    c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN q USING (vec_id), s"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark, sf_dir):
    return ball_codes.encode(table(spark, sf_dir, "embeddings"))

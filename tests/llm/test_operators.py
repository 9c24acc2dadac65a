"""The operators against brute force, on small tables with nulls, empty and odd texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from logsieve.llm import chat, language_model, line_dedup, ngram_join, packing, pieces, pii, quality, queries, token_counts, vector_dedup
from logsieve.llm.store import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, id string, component string, stratum long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "on", "é", "wa", "st") for b in ("e", "ing", "au") for c in ("", "r", "nd")]
    words = rng.choice(vocabulary, n)
    return "".join(w + ("\n" if i % 13 == 12 else " ") for i, w in enumerate(words))


def texts():
    base = prose(1, 120)
    near = [base.replace(" ", f" extra{k} ", 1) for k in range(6)]
    shared = "This line is in many of the documents here.\n"
    odd = [None, "", " ", "\n", "\n\n a", "one two", "日本語 テキスト", "it's <|endoftext|> </s>", "x" * 3000, "▁ a ▁▁b", "Nul \x00 and \x1c", "a.b.c,d!"]
    personal = [
        "mail a.b@c.org_x@d.example.com, ip 10.0.0.1.5 and 999.1.1.1, card 4111 1111 1111 1111 or 4111111111111112",
        "é +1 (555) 010-9999 call, IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, token = \"0123456789abcdef0123456789abcdef\" 0123456789abcdef0123456789abcdee",
    ]
    lines = [shared + prose(s, 60) + "\n  " + shared.upper() for s in range(10, 16)]
    return odd + personal + [base] * 4 + near + lines + [prose(s, 700) for s in range(20, 24)] + [" ".join(["same words again"] * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", "s", None, "clash", "x", "y", 3, "no") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd_rows(spark, docs):
    """Repeated rows and rows without an id."""
    extra = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None), (None, prose(1, 120), "en", "s", 1, None, None, None, None, None)], SCHEMA)
    return docs.unionByName(docs.where("doc_id % 5 = 0")).unionByName(extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(None, 1), (3, None)], "doc_id long, quality int")


def empty(docs):
    return docs.where("doc_id < -100")


def library_ids(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, odd_rows):
    cache = fresh_path(spark, "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, cache, BPE).collect()}
    assert got == {i: (len((t or "").encode()), len(library_ids(t))) for i, t in enumerate(texts())}
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts()})
    again = token_counts.count_tokens(odd_rows, cache, BPE)
    assert again.count() == odd_rows.count() and again.where("n_tokens is null").count() == 0
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded twice
    assert token_counts.count_tokens(empty(docs), fresh_path(spark, "cache"), BPE).count() == 0


def test_packing(docs, odd_rows):
    for rows in (docs, odd_rows):
        got = packing.pack(rows, BPE, window=64, open_windows=4).collect()
        pieces_of, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            pieces_of[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 64
        assert sum(map(len, sequences.values())) == len(got)
        if rows is docs:
            for i, t in enumerate(texts()):
                ids, at = [*library_ids(t), 0], 0
                for r in sorted(pieces_of[i], key=lambda r: r.start):
                    assert r.start == at and r.doc_tokens == len(ids)
                    assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                    at += r.length
                assert at == len(ids)
            total = sum(len(library_ids(t)) + 1 for t in texts())
            assert total >= 0.9 * 64 * len(sequences)
    assert packing.pack(empty(docs), BPE).count() == 0


def test_best_fit_emits_the_fullest():
    windows = packing.OpenWindows(10, 2, 0)
    assert [windows.place(n) for n in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    assert windows.place(9) == (3, 0) and windows.place(9)[0] == 4 and len(windows.room) == 2


def measure(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p + k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(docs, odd_rows, labels):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts()):
        m = measure(t)
        assert got[i][:5] == m
        assert got[i][5] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    assert quality.judge(odd_rows, labels).count() == odd_rows.count()
    assert set(quality.judge(odd_rows, labels, keep_columns=True).columns) == set(odd_rows.columns)
    assert quality.judge(empty(docs), labels).count() == 0
    assert quality.judge(docs, labels.where("doc_id < 0")).where("not base_failed and not kept").count() == 0


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(50, 0), (400, 3), (2000, 1), (5000, 20), (100, 2), (3000, 16)]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in rows:
        exact = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k >= 0.01 * r.n else exact, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    rng = np.random.default_rng(3)
    rule = (quality.Rule("r", "value", (0.9, 0.5, 0.3, 0.1)),)
    rows = [("a", float(v)) for v in rng.random(3000) * 0.31] + [("b", 0.0)] * 20
    got = {r.stratum: r.cut_r for r in quality.certified_cutoffs(spark.createDataFrame(rows, "stratum string, value double"), rule, 0.05, 0.05, 2).collect()}
    assert got == {"a": 0.3, "b": None}  # 20 rows can't certify anything


def test_joint_path_certifies_small_strata(spark):
    assert quality.least_labels(0.03, 0.05, 4) == 144
    steps = quality.joint_path(quality.RULES)
    assert len(steps) == 1 + sum(len(r.cutoffs) - 1 for r in quality.RULES) and steps[-1] == tuple(len(r.cutoffs) - 1 for r in quality.RULES)
    plain = "\n".join(" ".join(f"{a}{b}" for b in range(10)) for a in "abcdef")
    loud = plain.replace("a", "A!!").replace("b", "B!!").replace("c", "C!!")
    sizes = {"large": 500, "least": 144, "few": 143, "none": 0}
    rows = [(f"{lang}{i}", plain, lang) for lang, n in sizes.items() for i in range(n)]
    rows += [(f"{lang}-bad", loud, lang) for lang in sizes]
    rows = [(i, t, lang, name) for i, (name, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, name string")
    labels = spark.createDataFrame([(i, int(not n.endswith("bad"))) for i, _, _, n in rows] + [(9999, 1)], "doc_id long, quality int")
    got = {r.name: r.kept for r in quality.judge(docs, labels, risk=0.05 * 3 / 4, keep_columns=False).join(docs.select("doc_id", "name"), "doc_id").collect()}
    assert {n for n, kept in got.items() if not kept} == {"large-bad", "least-bad"}  # three strata have labels
    per_rule = quality.judge(docs, labels, joint=False)
    assert per_rule.where("not kept").count() == 0


def spans(text):
    text = text or ""

    def luhn(h):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", h))]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 10 <= len(re.sub("[^0-9]", "", h)) <= 15),
    ]
    return sorted((m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))


def test_personal_data(docs, odd_rows):
    found = {r.doc_id: r.pii_spans for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts()):
        assert [(s.start, s.end, s.kind) for s in found[i] if s.kind in pii.BASE_KINDS] == [(a, b, k) for a, _, b, k in spans(t)]
    kinds = Counter(s.kind for v in found.values() for s in v)
    assert kinds["iban"] == 1 and kinds["ssn"] == 1 and kinds["secret"] == 1 and kinds["card"] >= 1
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, t in enumerate(texts()):
        if found[i]:
            assert "[" in clean[i] and not spans(clean[i])
        else:
            assert clean[i] == t
    assert pii.redact(odd_rows).count() == odd_rows.count() and pii.find_pii(empty(docs)).count() == 0


def turns(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|>\n \\ back\\slash"), (1, 1, "assistant", "</s>[INST] ok [/INST] <<<SYS>>>"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, "x"), (3, 1, "us\ner\\", "[INST"), (None, 0, "user", "q"), (4, 0, "user", "<|turn|>assistant\nno")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments", "'z' AS number")
    formatted = chat.format_conversations(frame)
    for r in formatted.collect():
        body = r.segments[1].text
        assert not any(c in body for c in chat.Template().controls())
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, group in by.items():
        group = turns(group)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in group)
        loss = "".join(r[3] or "" for r in group if r[2] == "assistant")
        assert got[conv].n_turns == len(group) and got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: False, None: False, 4: False}
    assert chat.read_back(chat.format_conversations(frame.where("conv_id < 0"))).count() == 0


def test_line_dedup(spark, docs, odd_rows):
    keys = lambda t: [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in enumerate(texts()):
        for k in keys(t):
            if len(k) >= 20:
                holders[k].add(i)
    for batches, fanout in ((1, 2), (5, 2)):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
        for i, t in enumerate(texts()):
            lines = (t or "").split("\n")
            keep = [x for x, k in zip(lines, keys(t), strict=True) if not (len(holders[k]) >= 3 and max(holders[k]) != i)]
            assert got[i] == ("\n".join(keep), len(lines), len(lines) - len(keep))
    rows = line_dedup.dedup_lines(odd_rows)
    assert rows.count() == odd_rows.count()
    assert rows.where("doc_id is null and n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fresh_path(spark, "runs"), fanout=2)
    batches = [[(b"a", 1), (b"b", 1)], [(b"a", 2), (b"c", 3), (b"a", 2)], [(b"a", 9), (b"d", 4)], [(b"c", 8)]]
    new = [{bytes(r.line_hash) for r in runs.add(spark.createDataFrame(b, "line_hash binary, doc long")).collect()} for b in batches[:1]]
    for b in batches[1:]:
        new.append({bytes(r.line_hash) for r in runs.add(spark.createDataFrame(b, "line_hash binary, doc long")).collect()})
    assert new == [{b"a", b"b"}, {b"c"}, {b"d"}, set()]
    assert {bytes(r.line_hash): (r.n_docs, r.last_doc) for r in runs.counts().collect()} == {b"a": (3, 9), b"b": (1, 1), b"c": (2, 8), b"d": (1, 4)}
    assert len(runs.levels) > 1  # was compacted


def test_pieces(docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {r.doc_id: list(r.ids) for r in pieces.encode(docs, PIECES, dropout=0.0).collect()}
    for i, t in enumerate(texts()):
        if pieces.MARK not in (t or ""):
            assert plain[i] == library.encode(t or "")
    varied = pieces.decode(pieces.encode(docs, PIECES, dropout=0.3, seed=5), PIECES).collect()
    assert all(r.decoded == (r.text or "") for r in varied)
    assert sum(len(r.ids) for r in varied) > sum(map(len, plain.values()))
    again = {r.doc_id: r.ids for r in pieces.encode(docs, PIECES, dropout=0.3, seed=5).collect()}
    assert again == {r.doc_id: r.ids for r in varied}
    assert again != {r.doc_id: r.ids for r in pieces.encode(docs, PIECES, dropout=0.3, seed=6).collect()}
    assert pieces.encode(odd_rows, PIECES).count() == odd_rows.count() and pieces.encode(empty(docs), PIECES).count() == 0


def test_pieces_together_as_one_by_one():
    encoder = pieces.DropoutEncoder(pieces.piece_model(PIECES), 0.2, 3, 2)
    parts = [(v, p) for v in (0, 1) for p in ("▁therefore", "▁▁▁x", "éèüß", "日本", "12345", "▁a")]
    together = encoder.segment_together([p for _, p in parts], np.array([v for v, _ in parts]))
    for (v, p), ids in zip(parts, together, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == [i for s in encoder.segment(p, v) for i in encoder.model.symbol_ids(s)]


def test_pieces_runs_of_blanks():
    """Merges of blanks rank far behind all others; they are skipped at their own places only."""
    model = pieces.piece_model(PIECES)
    encoder = pieces.DropoutEncoder(model, 0.1, 11)
    lines = [("x" + " " * n + "y\n") * 50 for n in range(1, 28)]
    found = encoder.encode(lines, list(range(len(lines))))
    for i, (line, ids) in enumerate(zip(lines, found, strict=True)):
        cut = model.part.findall(" " + line)
        draws = pieces.mix(np.arange(len(cut), dtype=np.uint64) + pieces.mix(np.array([i], np.uint64) ^ encoder.key))
        alone = [k for p, d in zip(cut, draws, strict=True) for s in encoder.segment(p.replace(" ", pieces.MARK), int(d)) for k in model.symbol_ids(s)]
        assert np.frombuffer(ids, np.int32).tolist() == alone


def test_pieces_decode_together():
    """Lists are decoded by array operations: in far less time than it takes to make Python numbers of the ids."""
    import time

    import pyarrow as pa

    model = pieces.piece_model(PIECES)
    rng = np.random.default_rng(7)
    known = list(model.ids.values()) + model.byte_ids
    rows = [None, [], [model.byte_ids[200]], [model.byte_ids[0xC3], model.byte_ids[0xA9], model.ids["a"]]]
    rows += [rng.choice(known, n).tolist() for n in rng.integers(0, 40, 300)]
    text = {i: p.replace(pieces.MARK, " ").encode() for p, i in model.ids.items()} | {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
    expected = [None if r is None else b"".join(text[i] for i in r).decode(errors="replace")[1:] for r in rows]
    lists = pa.array(rows, pa.list_(pa.int32()))
    for first, last in ((0, len(rows)), (1, 3), (3, 200), (0, 1), (5, 5)):
        batch = pa.RecordBatch.from_arrays([lists.slice(first, last - first)], ["ids"])
        assert [t for b in pieces._decoding(PIECES, 0)([batch]) for t in b.column("decoded").to_pylist()] == expected[first:last]
    large = pa.RecordBatch.from_arrays([pa.array([rng.choice(known, 1000) for _ in range(400)], pa.list_(pa.int32()))], ["ids"])
    times = []
    for work in (lambda: list(pieces._decoding(PIECES, 0)([large])), large.column(0).to_pylist):
        runs = []
        for _ in range(3):
            began = time.process_time()
            work()
            runs.append(time.process_time() - began)
        times.append(min(runs))
    assert times[0] < times[1] / 2


def components(links, nodes):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def test_ngram_join(spark, docs, odd_rows):
    rows = {i: t for i, t in enumerate(texts())}
    chain = [" ".join(f"w{j}" if j > 6 * k else f"v{j}" for j in range(60)) for k in range(8)]
    rows |= {1000 + k: t for k, t in enumerate(chain)}
    frame = docs.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(chain)], "doc_id long, text string"), allowMissingColumns=True)
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 20
    expected = components(links, sets)
    for block in (2, 2048):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(frame, block=block).collect()}
        assert got == {i: (len(sets[i]), expected[i]) for i in sets}
    assert ngram_join.jaccard_join(odd_rows).count() == odd_rows.where("doc_id is not null").count()
    assert ngram_join.jaccard_join(empty(docs)).count() == 0


def test_crossing_over_batches():
    """Groups that end in a later batch give the same pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 200
    h = np.sort(rng.integers(0, 12, n))
    columns = [h, np.arange(n), np.full(n, 50, np.int32), rng.integers(0, 4, n).astype(np.int32), rng.integers(0, 5, n)]
    unsigned = [np.zeros(n, bool), *[np.zeros(n, np.int64) for _ in ngram_join.SIGNS]]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, *unsigned]], ["h", "set", "n", "pos", "component", "signed", *ngram_join.SIGNS])
    pairs = lambda size: {p for b in ngram_join._crossing(75, 16)([whole.slice(i, size) for i in range(0, n, size)]) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)}
    brute = {(a, b) for a in range(n) for b in range(a + 1, n) if h[a] == h[b] and columns[4][a] != columns[4][b] and ngram_join.possible(50, columns[3][a], 50, columns[3][b], 75)}
    assert pairs(n) == brute == pairs(7)


def test_dropout_varies_by_occurrence():
    model = pieces.piece_model(PIECES)
    encoder = pieces.DropoutEncoder(model, 0.1, 11)
    words = ["information", "a", "therefore", "x" * 40]
    text, n = " ".join(words * 250), 12
    found = encoder.encode([text] * n, list(range(n)))
    assert found == pieces.DropoutEncoder(model, 0.1, 11, 1).encode([text] * n, list(range(n)))  # forgets after each group
    assert found[3] == encoder.encode([text], [3])[0]
    cut = model.part.findall(" " + text)
    draws = pieces.mix(np.arange(len(cut), dtype=np.uint64) + pieces.mix(np.array([3], np.uint64) ^ encoder.key))
    one_by_one = b"".join(encoder.segment_together([p.replace(" ", pieces.MARK) for p in cut], draws))
    assert found[3] == one_by_one
    forms = Counter(tuple(np.frombuffer(i, np.int32)) for i in encoder.encode([" therefore"] * 5000, list(range(5000))))
    assert len(forms) > 4
    root = encoder.roots["  therefore"]
    merges = int(encoder.merges.ends[root + 1] - encoder.merges.ends[root])
    nodes = np.full(20_000, root)
    encoder._walk(nodes, pieces.mix(np.arange(20_000, dtype=np.uint64)))
    assert (nodes == root).mean() == pytest.approx(0.9**merges, abs=0.02)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    vectors = [centres[i % 40] + rng.standard_normal(16) * rng.choice([0.05, 0.25]) for i in range(300)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    rows += [(500 + i, rows[0][1]) for i in range(5)] + [(600, None), (601, [0.0] * 16), (602, [None] + [1.0] * 15), (603, [float("nan")] * 16), (604, [1.0, 2.0]), (605, [2.0, 4.0]), (606, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS id", "'x' AS codes")
    usable = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in usable.items()}
    links = {(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9}
    for block in (8, 1024):
        got = {r.vec_id: r for r in vector_dedup.link_vectors(frame, block=block, recall=0.9999).collect()}
        assert set(got) == {r[0] for r in rows}
        degree = Counter(x for p in links for x in p)
        assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * len(links)
        assert all(got[i].n_links <= degree[i] for i in got)
        assert all(got[i].n_links == 0 and got[i].kept for i in (600, 601, 602, 603, 606)) and got[605].component_id == 604
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vector_dedup.link_vectors(frame.where("vec_id < 0")).count() == 0


def shifted(n, dimension, share, seed):
    """Unit vectors with a common direction, each third one followed by a neighbour at cosine 0.905."""
    rng = np.random.default_rng(seed)
    common = np.eye(1, dimension)[0] * share
    x = common + rng.standard_normal((n, dimension)) * math.sqrt((1 - share**2) / dimension)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((n // 3, dimension))
    a = x[::3][: n // 3]
    u -= (u * a).sum(1, keepdims=True) * a
    b = 0.905 * a + math.sqrt(1 - 0.905**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    return np.concatenate([x, b]), a, b


def test_recall_on_shifted_vectors(spark):
    x, a, b = shifted(6000, 64, 0.8, 8)
    width, rotations = vector_dedup.fit_tables(x, 52_000, 64, 0.9, 0.97, 7)

    def recall(used, width):
        codes = [np.stack([(((v - m) @ p >= 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64) for m, p in used], 1) for v in (a, b)]
        one, other = (vector_dedup.substrings(c, width, 64) for c in codes)
        return (one == other).any(1).mean()

    planned_width, planned = vector_dedup.plan_tables(52_000, 64, 0.9, 0.97)
    assert recall(rotations[:planned], planned_width) < 0.9 and recall(rotations, width) >= 0.96  # the plan alone loses links here
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = int((np.triu(unit @ unit.T, 1) >= 0.9).sum())
    found = sum(r.n_links for r in vector_dedup.link_vectors(frame, threshold=0.9).collect()) // 2
    assert 0.96 * links <= found <= links


def test_language_model(spark, docs, odd_rows):
    got = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    tokens = {i: [*WORD.findall(lower(t or "")), None] for i, t in enumerate(texts())}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    train = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(train[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert got[i].score < 0
    assert language_model.score_documents(odd_rows).count() == odd_rows.count()
    assert language_model.score_documents(empty(docs)).count() == 0


@pytest.mark.parametrize("depth", [2, 5])
def test_context_tree_against_recursion(spark, depth):
    """Weights and mixture by the definition, over dictionaries, on a short text; probabilities of all bytes sum to 1."""
    train, tested = ["abracadabra abracadabra", "abba"], ["abra", "cab zz", ""]
    context = int.from_bytes(b"acadabra"[-depth:], "big") << 8
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def steps(text):
        data = bytes(depth) + lower(text).encode() + b"\0"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[:i], (1 << j) | data[i] >> (8 - j), data[i] >> (7 - j) & 1

    for t in train:
        for before, node, bit in steps(t):
            for d in range(depth + 1):
                counts[d][before[len(before) - d :], node][bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(d, key):
        own = kt(*counts[d][key])
        if d == depth:
            return own
        below = sum(weighted(d + 1, k) for k in list(counts[d + 1]) if k[1] == key[1] and k[0][1:] == key[0])
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    def predict(before, node, bit):
        p = None
        for d in range(depth, -1, -1):
            key = (before[len(before) - d :], node)
            if key in counts[d]:
                a = counts[d][key]
                own = (a[bit] + 0.5) / (sum(a) + 1)
                w = 1.0 if d == depth else math.exp(math.log(0.5) + kt(*a) - weighted(d, key))
                p = own if p is None else w * own + (1 - w) * p
        return 0.5 if p is None else p

    def counted(text):
        return Counter(language_model.text_grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), depth)[0].tolist())

    learned = sum((counted(t) for t in train), Counter())
    keys = {*learned, *(context | b for b in range(256)), *(g for t in tested for g in counted(t))}
    table = spark.createDataFrame([(g, learned[g], 1) for g in keys], "gram long, c long, n long")
    scores = {r.gram: r.score for r in language_model.score_grams(table, depth).collect()}
    for text in tested:
        expected = sum(math.log10(predict(*s)) for s in steps(text))
        assert sum(scores[g] * n for g, n in counted(text).items()) == pytest.approx(expected, rel=1e-9)
    assert sum(10 ** scores[context | b] for b in range(256)) == pytest.approx(1)


def test_rare_words_and_grams_score_alike(spark, docs, monkeypatch):
    """What is sent to all tasks and what is joined give the same scores, also where subtrees come in many parts."""
    rows = docs.unionByName(docs.limit(3))
    once = sorted(language_model.score_documents(rows).collect())
    for name, value in (("FREQUENT", 5), ("FREQUENT_GRAMS", 40)):
        monkeypatch.setattr(language_model, name, value)
    for a, b in zip(once, sorted(language_model.score_documents(rows).collect()), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_model_predicts_held_out_text(spark):
    """Text of the same kind costs far less than 8 bits a byte, random bytes more."""
    rows = [(i, prose(i, 300)) for i in range(60)] + [(1000 + i, "".join(chr(33 + int(x)) for x in np.random.default_rng(i).integers(0, 90, 500))) for i in range(5)]
    scored = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r.bits_per_byte for r in scored if r.held_out and r.doc_id < 1000]
    assert held and max(held) < 3 < min(r.bits_per_byte for r in scored if r.held_out and r.doc_id >= 1000) if any(r.held_out and r.doc_id >= 1000 for r in scored) else max(held) < 3


def test_pipeline_stages(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    columns = list(corpus_pipeline.COLUMNS)
    docs.select(*columns).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.written(stage(spark, rows, folder), "test")
        assert name == "packing" or rows.columns == columns
        sizes.append(rows.count())
        if name == "quality rules":
            assert sorted(r.doc_id for r in rows.collect()) == [i for i, t in enumerate(texts()) if (m := measure(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert sizes[0] == sizes[1] > sizes[2] == sizes[3] and corpus_pipeline.run(spark, folder).count() == sizes[4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0"), folder).count() == 0


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in queries.QUERIES}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_personal_data_in_a_text_of_many_spans(spark):
    text = "\n".join(f"é𝄞 u{i}@mail.example.org 10.0.{i % 256}.7 +49 (0)30 {1000000 + i}" for i in range(10_000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_pii(rows).first().pii_spans
    expected = spans(text)
    assert len(expected) == 30_000
    assert [(s.start, s.end, s.kind) for s in found if s.kind in pii.BASE_KINDS] == [(a, b, k) for a, _, b, k in expected]
    clean = pii.redact(rows).first().text.split("\n")
    assert set(clean) == {"é𝄞 [EMAIL] [IP] [PHONE]"} and len(clean) == 10_000


def test_context_on_both_sides_decides_for_added_kinds(spark):
    iban = "DE89370400440532013000"
    cases = ["123-45-6789", "ssn 123-45-6789", "123-45-6789 social security", "sample " + iban, iban, iban + " (example)", iban + " sample account", "x" * 300 + " 123-45-6789 ssn"]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.score) for s in r.pii_spans] for r in pii.find_pii(rows).collect()}
    assert found == {0: [], 1: [("ssn", 0.6)], 2: [("ssn", 0.6)], 3: [], 4: [("iban", 0.6)], 5: [], 6: [("iban", 0.7)], 7: [("ssn", 0.6)]}


def test_vectors_of_one_id(spark):
    rng = np.random.default_rng(5)
    first, second = rng.standard_normal((2, 24))
    near = lambda v: v + 0.01 * rng.standard_normal(24)
    pairs = [(i, rng.standard_normal(24)) for i in range(10, 48)] + [(5, first), (5, second), (60, near(first)), (61, near(second)), (61, second), (2, second)]
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in pairs], "vec_id long, embedding array<double>")
    unit = np.stack([v / np.linalg.norm(v) for _, v in pairs])
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    expected = Counter((i, int(n)) for (i, _), n in zip(pairs, links, strict=True))
    got = vector_dedup.link_vectors(frame, recall=0.9999).collect()
    assert Counter((r.vec_id, r.n_links) for r in got) == expected
    component = {(r.vec_id, r.n_links): r.component_id for r in got}
    assert component[5, 1] == 5 and component[60, 1] == 5 and component[5, 3] == 2 and component[61, 3] == 2 and component[2, 3] == 2
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)

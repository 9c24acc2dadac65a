"""Sum-of-squares packing, the Merkle manifest and the vector codes against brute force, with nulls, ties and repeated rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsieve.llm import ball_codes, gap_packing, manifest
from logsieve.llm.store import written

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["alpha", "beta gamma", "délta", "x", "\n"], n))


# ---- packing


def squares_after(counts, size, gap, length):
    """Sum of squares of open windows per gap when a length goes into a window of this gap (size: a new one)."""
    after = dict(counts)
    if gap < size:
        after[gap] -= 1
    if gap > length:
        after[gap - length] = after.get(gap - length, 0) + 1
    return sum(v * v for v in after.values())


@pytest.mark.parametrize("reluctant", [False, True])
def test_every_place_has_the_smallest_sum_of_squares(reluctant):
    rng = np.random.default_rng(3)
    for size in (7, 30):
        packer, gaps = gap_packing.GapCounts(size, reluctant), {}
        for length in rng.integers(1, size, 300).tolist():
            counts = defaultdict(int)
            for gap in gaps.values():
                counts[gap] += gap > 0
            counts = {g: n for g, n in counts.items() if n and g}
            options = {g: squares_after(counts, size, g, length) for g in counts if g >= length}
            if not (reluctant and options):
                options[size] = squares_after(counts, size, size, length)
            window, offset = packer.place(length)
            gap = gaps.get(window, size)
            assert offset == size - gap
            assert options[gap] == min(options.values()) and gap == min(g for g, v in options.items() if v == min(options.values()))
            gaps[window] = gap - length
        assert packer.made == len(gaps)


def test_place_all_is_close_to_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 100, 3000).tolist(), [60] * 50 + [40] * 50, [51] * 40, [], [99, 1]):
        places = gap_packing.place_all(lengths, 100)
        used = defaultdict(list)
        for (window, offset), n in zip(places, lengths, strict=True):
            used[window].append((offset, n))
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 100
        large = sum(n > 50 for n in lengths)
        assert len(used) <= max(large, math.ceil(sum(lengths) / 100 * 1.01) + 1)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, piece string, start string, sequence_id string, id string, row string, offset string"


def texts():
    return [None, "", "one", "日本語", "it's <|endoftext|>", prose(1, 40), prose(2, 90), prose(3, 500), "y" * 4000] + [prose(s, 10 + s) for s in range(10, 60)]


def test_gap_packing(spark):
    rows = [(i, t, "s", "en", 1, *"abcdef") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.unionByName(docs.where("doc_id % 4 = 0")).unionByName(spark.createDataFrame([(None, "no id", *[None] * 9), (None, None, *[None] * 9)], SCHEMA))
    library = Tokenizer.from_file(BPE)
    for table, group_rows in ((docs, 1 << 14), (docs, 16), (odd, 16)):
        got = gap_packing.pack(table, BPE, window=64, group_rows=group_rows).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append(r)
        for spans in sequences.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 64
        if table is docs:
            total = 0
            for i, t in enumerate(texts()):
                ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
                total += len(ids)
                own = sorted(pieces[i], key=lambda r: r.piece)
                assert [r.piece for r in own] == list(range(math.ceil(len(ids) / 64)))
                assert [r.length for r in own] == [len(ids) - 64 * (len(own) - 1), *[64] * (len(own) - 1)]
                at = 0
                for r in own:
                    assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                    at += r.length
            if group_rows == 1 << 14:
                short = [r.length for r in got if r.length < 64]
                least = len(got) - len(short) + max(sum(n > 32 for n in short), math.ceil(sum(short) / 64))
                assert total == sum(r.length for r in got) and len(sequences) <= least + 1
        else:
            assert len(pieces[None]) == 2 and len(pieces[0]) == 2
    assert gap_packing.pack(docs.where("doc_id < 0"), BPE).count() == 0
    text_ids = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in gap_packing.pack(text_ids, BPE).collect()} == {f"d{i}" for i in range(len(texts()))}


# ---- manifest


def brute_manifest(rows, arity):
    """Multiset of (id, leaf, subroot, root, siblings with their sides)."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(digests):
        """(root, steps of each)"""
        steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            runs = [level[i : i + arity] for i in range(0, len(level), arity)]
            for k, place in enumerate(at):
                run, slot = runs[place // arity], place % arity
                steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
                at[k] = place // arity
            level = [sha("".join(run)) for run in runs]
        return level[0], steps

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0], leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        trees[name] = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {name: tree([d for _, d in trees[name]]) for name in names}
    root, above = tree([subs[n][0] for n in names])
    return sorted(
        (str(i), d, subs[name][0], root, tuple(subs[name][1][k] + above[g]))
        for g, name in enumerate(names) for k, (i, d) in enumerate(trees[name])
    )


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest(spark, arity):
    rows = [(i, ("b", "a", None, "é", "")[min(4, i % 17)], "en" if i % 3 else None, i if i % 5 else None, prose(i, i % 9)) for i in range(100)]
    rows += rows[:7] + [(3, "b", None, None, None), (None, "a", "x", 1, ""), (None, None, None, None, None), (1000, "lone", "-", 0, "-")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, id string, idx string")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    made = written(manifest.manifest(docs, fields, arity=arity, carry=[F.length("text")]), "made")
    got = made.withColumns({"folded": manifest.fold(F.col("leaf"), F.col("steps")), "proof": manifest.proof_digest(F.col("steps"))}).collect()
    assert sorted((str(r.id), r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.steps)) for r in got) == brute_manifest(rows, arity)
    assert all(r.folded == r.root and r.proof == sha("".join(s.before + s.after for s in r.steps)) for r in got)
    assert {r.carried_0 for r in got if r.id == 1000} == {1}
    # a changed leaf gives another root
    assert made.where(manifest.fold(F.sha2("leaf", 256), F.col("steps")) == F.col("root")).count() == 0


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, text string"
    one = manifest.manifest(spark.createDataFrame([(5, "s", "t")], schema), ["doc_id", "source", "text"]).collect()
    assert [(r.id, r.leaf, r.subroot, r.root, r.steps) for r in one] == [(5, d := sha("1:51:s1:t"), d, d, [])]
    assert manifest.manifest(spark.createDataFrame([], schema), ["doc_id"]).count() == 0
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 250).alias("source"), F.lit("t").alias("text"))
    got = manifest.manifest(many, ["doc_id"]).collect()
    want = brute_manifest([(i, f"s{i % 250}") for i in range(300)], 3)
    assert sorted((str(r.id), r.subroot) for r in got) != [] and len({r.root for r in got}) == 1 and len(got) == len(want)


# ---- vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(order[0][1])
    order = [r for r in order if len(r[1]) == length]
    width = length // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for r in order:
                members[nearest(cut(r[1], p), books[p])[1]].append(cut(r[1], p))
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    errors, out = defaultdict(int), []
    for i, v, label in kept:
        if len(v) == length:
            found = [nearest(cut(v, p), books[p]) for p in range(parts)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
            errors[label] += out[-1][2]
        else:
            out.append((i, None, None, label))
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return sorted(((i, c, e, errors[label] if label in errors else None, digest) for i, c, e, label in out), key=str)


def vector_rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.1, 8)], None if i % 7 == 0 else i % 3) for i in range(300)]
    rows += [rows[3], (3, rows[5][1], 1), (None, rows[0][1], 2), (400, None, 1), (401, [float("nan")] * 8, 1), (402, [None] + [0.0] * 7, 1), (403, [float("inf")] * 8, None)]
    rows += [(404, [], 1), (405, [1.0] * 4, 9), (406, [0.0] * 8, 2), (407, [-0.0001] * 8, 2), (408, [1.0] * 5, 2)]
    return rows


@pytest.mark.parametrize(("entries", "broadcast"), [(256, True), (10, True), (10, False)])
def test_vector_codes(spark, entries, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(ball_codes, "BROADCAST_LABELS", 0)
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    got = sorted((tuple(r) for r in ball_codes.encode(table, entries=entries).collect()), key=str)
    assert got == brute_codes(rows, 4, entries, 4)
    assert got[0][4] and ball_codes.encode(table.where("vec_id < 0")).count() == 0
    assert [r.code for r in ball_codes.encode(table.where("vec_id in (404, 408)")).collect()] == [None, None]


def test_balls_skip_work_and_stay_exact():
    """Ties included: small whole numbers on a grid, entries that coincide, and clusters that hardly move."""
    rng = np.random.default_rng(2)
    for points, book in (
        (rng.integers(-3, 4, (3000, 3)), rng.integers(-3, 4, (40, 3))),
        ((rng.integers(-1000, 1000, (30, 4))[rng.integers(0, 30, 4000)] + rng.integers(-9, 10, (4000, 4))), None),
    ):
        if book is None:
            book = points[rng.choice(4000, 30, replace=False)]
        held, before, compared = None, None, 0
        for _ in range(6):
            balls = ball_codes.Balls(book, before)
            at, squared = balls.assign(points, held)
            d = ((points[:, None, :] - book[None]) ** 2).sum(2)
            assert (at == d.argmin(1)).all() and (squared == d.min(1)).all()
            compared += balls.compared
            held, before, book = at, book, book.copy()
            for k in np.unique(at):
                book[k] = points[at == k].sum(0) // (at == k).sum()
        assert compared < 6 * len(points) * len(book) * 0.6


def test_large_components_are_exact_or_refused():
    points = np.array([[2**27, -(2**27)], [2**27 + 1, -(2**27)]])
    assert ball_codes.exact_type(points, points) is np.int64
    at, squared = ball_codes.Balls(points).assign(points, np.array([1, 0]))
    assert at.tolist() == [0, 1] and squared.tolist() == [0, 0]
    with pytest.raises(OverflowError):
        ball_codes.whole_numbers(np.array([1e30]))

"""Graph, overlap, density and forest against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from logsieve.operators import correlate, density, forest, graph, overlap, similarity, textsets


def test_paths_against_enumeration(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12}
    out, into = {}, set()
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.add(b)
    nodes = {x for e in edges for x in e}
    starts = [n for n in nodes if n not in into]
    paths = {}

    def walk(path):
        if path[-1] not in out and len(path) >= 4:
            paths.setdefault((path[0], path[-1]), []).append(path)
        if len(path) <= 5:
            for b in out.get(path[-1], []):
                walk(path + [b])

    for s in starts:
        walk([s])
    expected = sorted(tuple(p) for ps in paths.values() for p in sorted(ps)[:3])
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    assert sorted(tuple(r.path) for r in graph.graph_paths(df).collect()) == expected and expected


@pytest.mark.parametrize(("seed", "parts"), [(1, 5000), (2, 4), (3, 5000)])
def test_paths_of_cyclic_graphs_against_enumeration(spark, seed, parts, monkeypatch):
    """Sources and sinks around a dense core full of cycles: the first three simple paths of every pair."""
    monkeypatch.setattr(graph, "GROUP_PATHS", parts)
    rng = random.Random(seed)
    core, sources, sinks = range(10, 10 + 5 + 2 * seed), range(3), range(50, 53)
    edges = {(a, b) for a in core for b in core if a != b and rng.random() < 0.5}
    edges |= {(s, rng.choice(core)) for s in sources for _ in range(3)} | {(rng.choice(core), e) for e in sinks for _ in range(2)}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    paths = {}

    def walk(path):
        if path[-1] in sinks and len(path) >= 4:
            paths.setdefault((path[0], path[-1]), []).append(path)
        if len(path) <= 5:
            for b in out.get(path[-1], []):
                if b not in path:
                    walk(path + [b])

    for s in sources:
        walk([s])
    expected = sorted((p[0], p[-1], i, p) for ps in paths.values() for i, p in enumerate(sorted(ps)[:3], 1))
    df = spark.createDataFrame([*edges, (None, 11), (12, None)], "src int, dst int")
    found = graph.graph_paths(df, min_graph_nodes=1).collect()
    assert sorted((r.start, r.end, r.position, r.path) for r in found) == expected and len(expected) > 10


def test_few_partial_paths_are_kept():
    """However many paths lead to a node, the number that continuations need is bounded by the length."""
    rng = random.Random(5)
    for length, left in ((1, 3), (2, 2), (3, 1)):
        kept = []
        for inner in sorted(tuple(rng.sample(range(200), length)) for _ in range(3000)):
            if graph._needed(frozenset(inner), kept, 3, left):
                kept.append(frozenset(inner))
        assert 3 <= len(kept) <= 3 * 20
        for _ in range(300):  # the first three that any continuation leaves open are among them
            later = set(rng.sample(range(200), left))
            assert sum(not k & later for k in kept) >= 3


def test_paths_need_a_large_graph(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    assert graph.graph_paths(df).count() == 0
    assert graph.graph_paths(df, min_graph_nodes=3).count() == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    expected = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    found = {r.node: r.component for r in overlap.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert found == expected


@pytest.mark.parametrize("over", [0.3, 0.6])
def test_jaccard_pairs(spark, over):
    rng = random.Random(7)
    sets = {i: frozenset(rng.sample(range(14), rng.randrange(1, 9))) for i in range(60)}
    sets[60] = sets[61] = sets[0]  # copies
    df = spark.createDataFrame([(i, t) for i, ts in sets.items() for t in ts], "id int, t int")
    pairs, members = overlap.set_overlap_pairs(df, "id", "t", over)
    names = {r.id: r.set_id for r in members.collect()}
    found = {frozenset((r.a_set, r.b_set)) for r in pairs.collect()}
    expected = set()
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x != y and len(x & y) / len(x | y) > over:
            expected.add(frozenset((names[a], names[b])))
    assert found == expected and names[60] == names[61] == names[0]


@pytest.mark.parametrize("over", [0.4, 0.75])
def test_similar_classes_against_all_pairs(spark, over):
    """Groups of near copies, chains and sets of their own: the classes are those of all pairs."""
    rng = random.Random(int(over * 100))
    sets = {i: frozenset(rng.sample(range(14), rng.randrange(1, 9))) for i in range(40)}
    trunk = list(range(100, 130))
    for i in range(40, 100):  # near copies of one set, all different
        sets[i] = frozenset([*rng.sample(trunk, 28), 200 + i])
    for i in range(100, 120):  # a chain, ends far apart
        sets[i] = frozenset(range(1000 + i, 1012 + i))
    df = spark.createDataFrame([(i, t) for i, ts in sets.items() for t in ts], "id int, t int")
    members, tokens = overlap.distinct_sets(df, "id", "t")
    found = {r.id: r.class_id for r in members.join(overlap.similar_classes(tokens, over), "set_id").collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if len(x & y) / len(x | y) > over:
            one, other = sorted((find(a), find(b)))
            root[other] = one
    assert found == {i: find(i) for i in sets}


def test_near_duplicate_classes(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, "something else entirely"), (5, "x"), (6, " "), (7, None)]
    found = similarity.near_duplicate_classes(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert {tuple(r) for r in found} == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 4), (5, 5, 5)}
    assert similarity.near_duplicate_classes(spark.createDataFrame([], "id int, text string"), "id", "text").collect() == []


def test_merge_findings(spark):
    sets = {"a": range(0, 10), "b": range(5, 12), "c": range(100, 110), "d": range(9, 60), "e": range(0, 10)}
    rows = [(f, str(e)) for f, es in sets.items() for e in es]
    entries = spark.createDataFrame(rows, "finding_id string, entry_id string")
    findings = spark.createDataFrame([(f, f.upper(), s, c) for f, s, c in [("a", "low", 0.5), ("b", "high", 0.4), ("c", "low", 0.9), ("d", "medium", 0.1), ("e", "low", 0.2)]], "finding_id string, type string, severity string, confidence double")
    merged = {r.findings: r for r in correlate.merge_findings(findings, entries).collect() if r.findings > 1}
    assert merged[3].severity == "high" and merged[3].confidence == 0.5 and merged[3].type == "A" and merged[3].events == 12


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, "something else entirely"), (5, "x")]
    pairs, members = similarity.near_duplicates(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    (row,) = pairs.collect()
    assert (row.first_key, row.second_key, row.first_members) == (1, 3, 2) and members.count() == 5


def _odd_texts(rng):
    """Near copies, piles of more than SMALL_GROUP of them, chains, short and odd texts, keys that come again or are null."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for pile in (2, 3, 12, 25):
        trunk = rng.sample(words, 40)
        texts += [" ".join(w if rng.random() < 0.97 else rng.choice(words) for w in trunk) for _ in range(pile)]
    chain = [f"c{i}" for i in range(80)]
    texts += [" ".join(chain[i : i + 30]) for i in range(0, 50, 4)]
    texts += ["one", "ONE", "one two", " one\ttwo ", "one two three", "\n", "\t\n", "ab ba", "ba ab", "É È É", "é è é", "a\u00a0b c d", " ", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (500, None), (3, texts[20]), (4, texts[4]), (4, texts[4]), (501, " ".join(rng.sample(words, 300)))]
    return rows


@pytest.mark.parametrize("over", [0.3, 0.6])
def test_near_texts_against_all_pairs(spark, over, monkeypatch):
    monkeypatch.setattr(textsets, "FEW_KEYS", 1 if over == 0.3 else 10_000)  # both ways of gathering the texts of a key
    rows = _odd_texts(random.Random(int(over * 10)))
    df = spark.createDataFrame(rows, "id int, text string")
    sets = {}
    for i, t in rows:
        if i is not None and t and t.strip(" "):
            w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x]
            sets.setdefault(i, set()).update(" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2)))
    head = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    heads = sorted(set(head.values()))
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(heads, 2)}
    pairs = {k: v for k, v in pairs.items() if v > over}
    found, members = similarity.near_duplicates(df, "id", "text", over=over)
    assert {(r.first_key, r.second_key): r.similarity for r in found.collect()} == pairs and len(pairs) > 20
    assert {(r.id, r.set_id, r.size) for r in members.collect()} == {(i, h, len(sets[i])) for i, h in head.items()}
    root = {i: i for i in heads}
    for a, b in sorted(pairs) * len(heads):
        root[b] = root[a] = min(root[a], root[b])
    classes = similarity.near_duplicate_classes(df, "id", "text", over=over).collect()
    assert sorted(tuple(r) for r in classes) == sorted((i, h, root[h]) for i, h in head.items())


def test_near_texts_move_less_than_their_sets(spark, tmp_path):
    """Shingles were written and shuffled one a row, several times the texts; texts without near copies are not moved now."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    df.write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    texts = textsets.texts_by_key(df, "id", "text")
    counts = spark.sparkContext.broadcast(textsets.element_counts(texts, 3))
    packed = texts.select("_ts").mapInArrow(textsets._packing(3, 0.5, counts, 4), textsets.PACKED).drop("part").collect()
    prefixes = sum(len(r.hashes) // 4 for r in packed)
    assert prefixes == sum(textsets.prefix_length(n, 0.5) for n in [398] * 400)
    assert sum(len(b) for r in packed for b in r) < 10 * prefixes
    found, _ = similarity.near_duplicates(df, "id", "text", over=0.5)
    assert found.count() == 0


@pytest.mark.parametrize("dims", [1, 2, 3, 4, 8])
def test_noise_against_all_pairs(spark, dims, monkeypatch):
    monkeypatch.setattr(density, "BOX_POINTS", 20)  # several boxes, and several blocks in the crowded ones
    rng = random.Random(dims)
    points = [tuple(rng.gauss(0, 0.2) for _ in range(dims)) for _ in range(150)] + [tuple(rng.uniform(-4, 4) for _ in range(dims)) for _ in range(60)]
    points += [points[0]] * 40  # a pile in one cell
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, " + ", ".join(f"{n} double" for n in names))
    eps = 0.3 * max(1, dims - 2)
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= eps * eps] for p in points]
    core = {i for i, js in enumerate(near) if len(js) >= 5}
    expected = sorted(i for i, js in enumerate(near) if i not in core and not core & set(js))
    found = density.cluster_noise(df, "id", names, eps=eps, scale=False)
    rows = found.collect()
    assert sorted(r.id for r in rows) == expected and expected and all(r.neighbours == len(near[r.id]) for r in rows)


def test_noise_deals_all_points_once(spark, monkeypatch):
    """The points that probes are compared with went to every box within eps of them, many times the table."""
    monkeypatch.setattr(density, "BOX_POINTS", 20)
    rng = random.Random(9)
    points = [tuple(rng.uniform(-4, 4) for _ in range(4)) for _ in range(400)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, a double, b double, c double, d double")
    dealt, real = spark.sparkContext.accumulator(0), density._dealing

    def dealing(tree, dims, margin):
        run = real(tree, dims, margin)

        def counted(batches):
            for batch in run(batches):
                if "_w" in batch.schema.names:
                    dealt.add(batch.num_rows)
                yield batch

        return counted

    monkeypatch.setattr(density, "_dealing", dealing)
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= 1.44] for p in points]
    core = {i for i, js in enumerate(near) if len(js) >= 5}
    found = density.cluster_noise(df, "id", [*"abcd"], eps=1.2, scale=False).collect()
    assert sorted(r.id for r in found) == [i for i, js in enumerate(near) if i not in core and not core & set(js)]
    assert 0 < dealt.value <= 4 * (len(points) + len(core))  # counted and compared, the core points once more


def test_noise_of_odd_rows(spark):
    names = ["a", "b", "c", "d"]
    rows = [(i, 0.0, 0.0, 0.0, 0.0) for i in range(30)] + [(100, 5.0, None, 0.0, 0.0), (101, float("nan"), 1.0, 1.0, 1.0), (102, 9.0, 9.0, 9.0, 9.0), (102, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    found = density.cluster_noise(df, "id", names, scale=False).collect()
    assert {(r.id, r.neighbours) for r in found} == {(102, 2)}
    assert density.cluster_noise(df.where("id < 0"), "id", names).count() == 0
    assert density.cluster_noise(df.limit(5), "id", names, scale=False).count() == 0


def test_boxes_cover_what_is_near():
    """Every pair within eps shares the home box of either point."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x, eps = rng.normal(0, 1, (500, 5)), 0.4
    tree = density.cut_boxes(x, 16, eps)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [pa.array(np.arange(500))], [*"abcde", "i"])

    def dealt(margin):
        out = [(b, i) for part in density._dealing(tree, 5, margin)([batch]) for b, i in zip(part.column(0).to_pylist(), part.column("i").to_pylist(), strict=True)]
        return out

    home, around = {i: b for b, i in dealt(0.0)}, set(dealt(eps))
    assert len(home) == 500 == len(dealt(0.0)) and len(set(home.values())) > 4
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    assert all((home[i], j) in around for i, j in zip(*np.nonzero(near), strict=True))


def test_forest_finds_the_odd_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(190)] + [(1000 + i, 50.0 + i, -40.0 - i) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    found = {r.id for r in forest.generic_outliers(df, "id").collect()}
    assert {1000 + i for i in range(10)} <= found and len(found) == 20
    assert forest.generic_outliers(df.limit(5), "id").count() == 0


def test_entity_pairs(spark):
    df = spark.createDataFrame([(1, "a", "b", None), (2, "b", "a", "c"), (3, "a", "a", "")], "id int, source string, target string, user string")
    found = {(r.src, r.dst): r.weight for r in graph.entity_edges(df).collect()}
    assert found == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert graph.event_edges(df, "id").groupBy("event").agg(F.count(F.lit(1)).alias("n")).orderBy("event").collect()[2].n == 1


def test_paths_with_cycles_are_simple(spark):
    from logsieve.operators.graph import graph_paths

    rows = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]
    found = graph_paths(spark.createDataFrame(rows, "src string, dst string"), min_nodes=3, min_graph_nodes=1).collect()
    assert [r.path for r in found] == [["a", "b", "c", "d"]]

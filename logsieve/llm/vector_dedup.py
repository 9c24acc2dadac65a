"""Vectors linked by cosine: learned binary codes, multi-index Hamming tables, then the original vectors.

Iterative quantisation learns rotations on a bounded sample; each rotation turns a vector into a code of balanced bits.
The codes are cut into substrings, each a table: vectors that agree in a substring meet in a bucket, where codes only are
moved and compared by Hamming distance, in blocks, whatever the size of a bucket. The original vectors are fetched for
those that have a partner within the radius, and compared in double precision.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.store import written
from logsieve.operators.overlap import connected_components

ROUNDS = 30  # of the alternation between codes and rotation
MAX_BITS = 64
RADIUS_ROTATIONS = 4  # of the codes of so many rotations the Hamming distance is taken


def learn_rotation(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of (v - mean) @ projection are balanced codes with little loss.

    Principal directions, then a rotation by alternation: the codes nearest to the rotated data, the rotation nearest to
    the codes.
    """
    mean = x.mean(0)
    _, directions = np.linalg.eigh(np.cov((x - mean).T) + 1e-9 * np.eye(x.shape[1]))
    projection = directions[:, ::-1][:, :bits]
    v = (x - mean) @ projection
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (left @ right).T
    return mean, projection @ rotation


def plan_tables(n: int, bits: int, threshold: float, recall: float) -> tuple[int, int]:
    """(width of a substring, number of rotations): buckets of about 64 vectors, and `recall` at the threshold.

    Two vectors at the threshold differ in a bit with probability angle / pi, so they agree in a whole substring with
    (1 - angle / pi) ** width; so many tables are taken that they meet in one of them with the wanted probability.
    """
    width = min(bits, max(4, math.ceil(math.log2(max(2, n))) - 6))
    meet = (1 - math.acos(threshold) / math.pi) ** width
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    return width, max(1, math.ceil(tables / (bits // width)))


def pairs_at(x: np.ndarray, threshold: float, count: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold: sample vectors, and the same turned by that angle in any direction or towards other vectors."""
    rng = np.random.default_rng([seed, 1])
    a, other = x[rng.integers(0, len(x), count)], x[rng.integers(0, len(x), count)]
    out = []
    for towards in (rng.standard_normal(a.shape), other):
        u = towards - (towards * a).sum(1, keepdims=True) * a
        norm = np.linalg.norm(u, axis=1, keepdims=True)
        usable = norm[:, 0] > 1e-6
        if usable.any():
            out.append((a[usable], threshold * a[usable] + math.sqrt(max(0.0, 1 - threshold**2)) * u[usable] / norm[usable]))
    return out


def fit_tables(x: np.ndarray, n: int, bits: int, threshold: float, recall: float, seed: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """(width of a substring, rotations) by which pairs at the threshold meet with probability `recall`.

    The plan holds for the angle between the vectors. Codes are signs after centring, which widens the angle where vectors
    share a direction, so the buckets that pairs made at the threshold meet in are counted: rotations are added until enough
    pairs meet, and beyond four times the plan substrings are made shorter instead (larger buckets, the same recall).
    """
    width, planned = plan_tables(n, bits, threshold, recall)
    pairs = pairs_at(x, threshold, max(4000, math.ceil(10 / (1 - recall))), seed)
    fitted = np.concatenate([x, x]) if len(x) < 2 else x
    rotations: list[tuple[np.ndarray, np.ndarray]] = []
    agree: list[list[np.ndarray]] = [[] for _ in pairs]  # of each kind of pair by rotation: equal bits
    met = [np.zeros(len(a), bool) for a, _ in pairs]

    def meeting(equal: np.ndarray) -> np.ndarray:
        per = bits // width
        return equal[:, : per * width].reshape(len(equal), per, width).all(2).any(1)

    while len(rotations) < planned or (any(m.mean() < recall for m in met) and len(rotations) < 4 * planned):
        mean, projection = learn_rotation(fitted, bits, seed + len(rotations))
        rotations.append((mean, projection))
        for kind, (a, b) in enumerate(pairs):
            agree[kind].append(((a - mean) @ projection >= 0) == ((b - mean) @ projection >= 0))
            met[kind] |= meeting(agree[kind][-1])
    while width > 1 and any(m.mean() < recall for m in met):
        width -= 1
        met = [np.any([meeting(e) for e in equal], 0) for equal in agree]
    return width, rotations


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of a to all rows of b, over the codes of the first rotations."""
    return sum(np.bitwise_count(a[:, None, r] ^ b[None, :, r]).astype(np.int32) for r in range(min(RADIUS_ROTATIONS, a.shape[1])))


def fit_radius(x: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], threshold: float, recall: float, seed: int) -> int:
    """The Hamming distance that pairs at the threshold exceed in a twentieth of the share 1 - `recall` only."""
    radius = 0
    for a, b in pairs_at(x, threshold, max(4000, math.ceil(40 / (1 - recall))), seed + 1):
        differ = sum((((a - mean) @ p >= 0) != ((b - mean) @ p >= 0)).sum(1) for mean, p in rotations[:RADIUS_ROTATIONS])
        radius = max(radius, math.ceil(np.quantile(differ, 1 - (1 - recall) / 20)))
    return radius


def _raw(value: pa.Scalar) -> np.ndarray | None:
    """The components of a usable vector."""
    if not value.is_valid:
        return None
    numbers = value.values
    if numbers is None or not len(numbers) or numbers.null_count:
        return None
    x = numbers.to_numpy(zero_copy_only=False)
    return x if np.isfinite(x).all() and np.any(x) else None


def _reading(batches):
    """(id, vector as bytes, digest); null where the vector links with nothing. A zero component has no sign here."""
    for batch in batches:
        vectors = [_raw(v) for v in batch.column(1)]
        blobs = [None if v is None else (v + np.zeros(1, v.dtype)).astype(v.dtype.newbyteorder("<")).tobytes() for v in vectors]
        digests = [None if b is None else hashlib.md5(b).digest() for b in blobs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(digests, pa.binary())], ["id", "vector", "digest"])


def unit(blobs: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).astype(np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coding(model, dtype: str):
    def run(batches):
        projections, dimension = model.value
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            codes = [b"\0" * 8 * len(projections)] * len(blobs)  # vectors of another length are compared with all of their length
            own = [i for i, b in enumerate(blobs) if len(b) == dimension * np.dtype(dtype).itemsize]
            if own:
                x = unit([blobs[i] for i in own], dtype)
                words = []
                for mean, projection in projections:
                    bits = (x - mean) @ projection >= 0
                    words.append((bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64))
                joined = np.stack(words, 1).astype("<u8")
                for i, c in zip(own, joined, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array([len(b) for b in blobs], pa.int32())], ["id", "codes", "size"])

    return run


def substrings(codes: np.ndarray, width: int, bits: int) -> np.ndarray:
    """codes: rows x rotations. The keys of all tables: rows x tables."""
    per, mask = bits // width, np.uint64((1 << width) - 1)
    return np.concatenate([(codes[:, r, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(width))) & mask for r in range(codes.shape[1])], 1)


def _keys(width: int, bits: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            keys = substrings(codes, width, bits)
            n, tables = keys.shape
            sizes = batch.column(2).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(sizes, tables))],
                ["id", "table", "key", "size"],
            )

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over the pairs."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the two blocks of a unit, and whether they are one."""
    i, j, side = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["side"].to_numpy()
    if i == j:
        every = np.arange(rows.num_rows)
        return every, every, True
    return np.flatnonzero(side == i), np.flatnonzero(side == j), False


def _pairs(rows: pa.Table, width: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a unit within the radius that meet in this table first."""
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<u8").reshape(rows.num_rows, -1)
    left, right, one = _sides(rows)
    a, b = np.nonzero(distances(codes[left], codes[right]) <= radius)
    a, b = left[a], right[b]
    if one:
        a, b = a[a < b], b[a < b]
    table = rows["table"][0].as_py()
    if len(a) and table:
        keys = substrings(codes, width, bits)[:, :table]
        first = np.ones(len(a), bool)
        for t in range(table):
            first &= keys[a, t] != keys[b, t]
        a, b = a[first], b[first]
    return a, b


def _near(width: int, bits: int, radius: int):
    """Of a unit the rows that have a partner within the radius."""

    def near(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        a, b = _pairs(rows, width, bits, radius)
        kept = np.unique(np.concatenate([a, b]))
        return rows.take(pa.array(kept)).combine_chunks().to_batches()[0] if len(kept) else None

    return _by_unit(near)


def _comparing(threshold: float, width: int, bits: int, radius: int, dtype: str):
    """Units of at most two blocks, sorted: links of each vector to the others that first meet in this table."""

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        a, b = _pairs(rows, width, bits, radius)
        left, right, _ = _sides(rows)
        x = unit(rows["vector"].to_pylist(), dtype)
        place = np.empty((2, len(ids)), np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        linked = (x[left] @ x[right].T >= threshold)[place[0, a], place[1, b]]
        a, b = a[linked], b[linked]
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        hit = np.flatnonzero(links)
        label = _labels(len(ids), a, b, ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(label[hit])], ["id", "links", "label"])

    return _by_unit(compare)


def _by_unit(of_unit):
    """Calls `of_unit` with the rows of each unit; rows are sorted by unit, of a batch the last unit waits for the next."""

    def run(batches):
        unit_of = ("table", "size", "key", "i", "j")
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            marks = np.zeros(rows.num_rows, bool)
            marks[0] = True
            for name in unit_of:
                v = rows[name].to_numpy()
                marks[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(marks)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (out := of_unit(rows.slice(a, b - a))) is not None:
                    yield out
            rest = rows.slice(starts[-1]).combine_chunks()
        if rest is not None and (out := of_unit(rest)) is not None:
            yield out

    return run


def link_vectors(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding",
    fit_rows: int = 20_000, block: int = 1024, seed: int = 7,
) -> DataFrame:
    """One row per vector: the id column, n_links, component_id (smallest id reachable by links) and kept (it is that id).

    A link is a cosine of at least `threshold`, in double precision. Null or zero vectors, and those with null or
    non-finite components, link with nothing. Vectors of different length never link. Rows whose id is null are left out;
    rows of one id are different vectors, each linked with the others that are similar, with those of its own id too. Other columns are
    ignored. An empty table gives no rows. Ids must be integers.

    The rotations are learned on `fit_rows` vectors, those of the smallest hashed ids; all vectors are indexed. Equal
    vectors become one with a number of copies. A link is counted in the first table in which its two codes agree, so
    none counts twice and no pairs leave a task: per compared unit (at most two blocks of a bucket) each vector gives its
    number of links and the smallest number that it reaches. Links between vectors that agree in no substring are missed:
    at the threshold a share of 1 - `recall` is expected, less for closer vectors (`fit_tables` measures it on the sample);
    a twentieth of that share more lies beyond the radius of the Hamming distance (`fit_radius`).
    """
    spark = vectors.sparkSession
    source = vectors.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    dtype = "<f4" if "float" in source.schema["v"].dataType.simpleString() else "<f8"
    source = source if dtype == "<f4" else source.withColumn("v", F.col("v").cast("array<double>"))
    read = written(source.mapInArrow(_reading, "id long, vector binary, digest binary"), "vectors")
    usable = read.where(F.col("digest").isNotNull())
    # a class is the set of equal vectors; it is numbered once, in a written table, since an id may have several vectors
    classes = usable.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    own = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = own.select("id", "digest", "least", "copies")
    alone = lambda rows: rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    n = own.count()
    sample = own.orderBy("digest").limit(fit_rows).select("vector").collect()
    if not sample:
        return alone(read)
    lengths, counts = np.unique([len(r["vector"]) for r in sample], return_counts=True)
    length = int(lengths[counts.argmax()])
    x = unit([bytes(r["vector"]) for r in sample if len(r["vector"]) == length], dtype)
    bits = min(x.shape[1], MAX_BITS)
    width, rotations = fit_tables(x, n, bits, threshold, recall, seed)
    radius = fit_radius(np.concatenate([x, x]) if len(x) < 2 else x, rotations, threshold, recall, seed)
    model = spark.sparkContext.broadcast((rotations, x.shape[1]))

    coded = written(own.select("id", "vector").mapInArrow(_coding(model, dtype), "id long, codes binary, size int"), "codes")
    keys = written(coded.mapInArrow(_keys(width, bits), "id long, table int, key long, size long"), "keys")
    bucket = ["table", "size", "key"]
    full = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block))
    placed = keys.join(full, bucket).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = placed.select("id", *bucket, "side", other.alias("other")).select("id", *bucket, "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    order = [*bucket, "i", "j"]
    met = units.join(coded.select("id", "codes"), "id").repartition(*order).sortWithinPartitions(*order, "id")
    near = written(met.mapInArrow(_near(width, bits, radius), met.schema), "near")
    rows = near.join(own.select("id", "copies", "vector"), "id").repartition(*order).sortWithinPartitions(*order, "id")
    found = rows.mapInArrow(_comparing(threshold, width, bits, radius, dtype), "id long, links long, label long")
    found = written(found, "links")
    components = connected_components(found.where("id <> label").select(F.col("id").alias("u"), F.col("label").alias("v")))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    smallest = components.join(classes, F.col("id") == F.col("node")).groupBy("component").agg(F.min("least").alias("smallest"))
    named = components.join(smallest, "component").select("node", "smallest")
    by_class = (
        classes.join(totals, "id", "left").join(named, F.col("id") == F.col("node"), "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    )
    met = read.select("id", "digest").join(by_class, "digest", "left")
    component = F.coalesce("component_id", "id")
    return met.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))

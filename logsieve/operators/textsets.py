"""Sets of word runs of many texts, met with each other without moving or keeping the sets.

The sets are several times larger than the texts, so they are made anew, batch by batch, wherever they are needed. What is
moved is an index of prefixes: the rarest elements of a set, as many as the threshold demands, packed by part of the hash
space: four bytes of the hash, the place in the set and, once a set and part, the set's digest and size. Rarity is by
counts in 2**COUNT_BITS buckets, of fixed size at any scale; the order decides how many candidates there are, never what is
found. Whole sets are moved for candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.session import cut_lineage

COUNT_BITS = 21
COUNT_ROWS = 1 << 16  # bucket counts are handed over in runs of so many
FLAG_BITS = 20  # of the flags by hashed key that tell which sets are wanted
SLICE_BYTES = 1 << 20  # of texts taken at once; a longer text is taken alone
ROWS = 1000  # rows with long values are handed over in batches of so many
HELD = 1 << 21  # elements of prefixes packed together
FLUSH = 1 << 18  # pairs held before they are handed over
FEW_KEYS = 10_000  # keys of several texts that are sent to all tasks
BLOCK_SETS = 256  # of a group of candidates that meet in one place
SMALL_GROUP = 8  # sets of one element that are all compared with each other at once
SLACK = 1e-9  # of products of sizes with a threshold, so that rounding drops no candidate

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8, so that powers differ in their low bits
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_SECOND = np.uint64(0x165667B19E3779F9)
_powers: dict[np.uint64, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        if len(known) <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


def _runs(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of `size` words of each text; a text of fewer words is one run. Words end at ASCII white space."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, len(data)), out=sums[1:])
    word = mix((sums[last] - sums[first]) * _power(_INVERSE, len(data) + 1)[first])
    owner = np.searchsorted(offsets, first, side="right") - 1
    words = np.bincount(owner, minlength=len(offsets) - 1)
    starts = np.cumsum(words) - words

    def joined(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n + 1, np.uint64)
        for i in range(n):
            h = mix(h * _STEP + word[at + i])
        return h

    whole = np.arange(max(0, len(word) - size + 1))
    whole = whole[owner[whole] == owner[whole + size - 1]]
    hashes, texts = [joined(whole, size)], [owner[whole]]
    for n in range(size):
        short = np.flatnonzero(words == n)
        hashes.append(joined(starts[short], n))
        texts.append(short)
    return np.concatenate(hashes), np.concatenate(texts)


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, elements, number of elements of each row) of parts of a column of lists of lower-case texts.

    The elements of a row are distinct and sorted; a row is the set of all its texts.
    """
    lists = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    texts = column.flatten().cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    borders = np.concatenate(([0], np.cumsum(lists)))
    reach = offsets[borders]
    row = 0
    while row < len(lists):
        to = max(row + 1, int(np.searchsorted(reach, reach[row] + SLICE_BYTES, side="right")) - 1)
        a, b = borders[row], borders[to]
        cut = offsets[a : b + 1]
        h, text = _runs(data[cut[0] : cut[-1]], cut - cut[0], size)
        owner = np.repeat(np.arange(to - row), lists[row:to])[text]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield row, h[new], np.bincount(owner[new], minlength=to - row)
        row = to


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _digest(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of sets that are not empty, by which the index names them."""
    return np.bitwise_xor.reduceat(mix(h * _STEP + _SECOND), _starts(n)) if len(n) else np.zeros(0, np.uint64)


def _parities(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set a bitmap that tells whether an odd number of its elements fall into a bucket; 64 buckets at least, 2 to 4 an element."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(2 * n)).astype(np.int64))
    at = np.repeat(_starts(bits), n) + (h & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    offsets = np.concatenate(([0], np.cumsum(bits // 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(odd)])


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer buckets, in so many words."""
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def texts_by_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _ts): the texts of each key in lower case. Rows without key and blank texts are left out; only texts of keys that come again are moved."""
    rows = df.where(F.col(key).isNotNull() & (F.trim(text) != "")).select(F.col(key).alias("_k"), F.lower(text).alias("_t"))
    again = cut_lineage(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k"))
    n = again.count()

    def gathered(some: DataFrame) -> DataFrame:
        return cut_lineage(some.groupBy("_k").agg(F.collect_list("_t").alias("_ts")))

    alone = F.array("_t").alias("_ts")
    if not n:
        return rows.select("_k", alone)
    if n > FEW_KEYS:
        return gathered(rows)
    few = F.broadcast(again)
    return rows.join(few, "_k", "left_anti").select("_k", alone).unionByName(gathered(rows.join(few, "_k", "left_semi")))


def _planes(x: np.ndarray) -> bytes:
    """Four-byte numbers byte by byte, so that the upper bytes of small ones compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _counting(size: int):
    """Elements by bucket, in runs of COUNT_ROWS buckets."""

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, h, _ in sets_of(batch.column(0), size):
                counts += np.bincount((h & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
        for i, some in enumerate(counts.reshape(-1, COUNT_ROWS)):
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_planes(some)])], ["run", "counts"])

    return run


def _summing(batches):
    sums = {}
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[i] = sums.get(i, 0) + _unplaned(counts)
    for i, some in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([some.astype(np.int64).tobytes()])], ["run", "counts"])


def element_counts(texts: DataFrame, size: int) -> np.ndarray:
    """Elements of all sets by bucket; 2**COUNT_BITS sums come to the driver."""
    counted = texts.select("_ts").mapInArrow(_counting(size), "run int, counts binary")
    out = np.zeros((1 << COUNT_BITS) // COUNT_ROWS * COUNT_ROWS, np.int64).reshape(-1, COUNT_ROWS)
    for r in counted.repartition("run").mapInArrow(_summing, "run int, counts binary").collect():
        out[r["run"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 0xFFFFFFFF).astype(np.uint32)


def _naming(size: int):
    def run(batches):
        for batch in batches:
            for row, h, n in sets_of(batch.column(1), size):
                second = np.add.reduceat(mix(h * _SECOND + _STEP), _starts(n))
                columns = [batch.column(0).slice(row, len(n)), pa.array(n.astype(np.int32)), pa.array(_digest(h, n).view(np.int64)), pa.array(second.view(np.int64)), _parities(h, n)]
                yield pa.RecordBatch.from_arrays(columns, ["_k", "size", "_x", "_y", "_odd"])

    return run


def named_sets(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(members: _k, set_id, size; heads: set_id, size, _x, _odd). Equal sets are one, named by the smallest key.

    `_x` is what the index calls it, `_odd` a bitmap by which sets that differ too much are told.
    """
    kind = texts.schema["_k"].dataType.simpleString()
    named = cut_lineage(texts.mapInArrow(_naming(size), f"_k {kind}, size int, _x long, _y long, _odd binary"))
    heads = cut_lineage(named.groupBy("size", "_x", "_y").agg(F.min("_k").alias("set_id"), F.min("_odd").alias("_odd")))
    members = cut_lineage(named.drop("_odd").join(heads.drop("_odd"), ["size", "_x", "_y"]).select("_k", "set_id", F.col("size").cast("long").alias("size")))
    return members, heads.select("set_id", F.col("size").cast("long").alias("size"), "_x", "_odd")


PACKED = "part int, digests binary, sizes binary, lengths binary, hashes binary, places binary"


def _packing(size: int, over: float, counts, parts: int):
    """Per part of the hash space the prefixes of many sets in one row, set by set."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def flushed(held):
        x, n = (np.concatenate([s[i] for s in held]) for i in (0, 1))
        h, pos = (np.concatenate([s[i] for s in held]) for i in (3, 4))
        owner = np.repeat(np.arange(len(x)), np.concatenate([s[2] for s in held]))
        only = np.zeros(len(x), bool)
        only[np.unique(x, return_index=True)[1]] = True  # copies among them once
        keep = only[owner]
        h, pos, owner = h[keep], pos[keep], owner[keep]
        part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, pos, owner = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), pos[order], owner[order]
        borders = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
        rows = []
        for p in np.flatnonzero(np.diff(borders)):
            a, b = borders[p], borders[p + 1]
            first = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
            sets = owner[a:b][first]
            rows.append((int(p), x[sets].tobytes(), _planes(n[sets]), _planes(np.diff(np.append(first, b - a))), h[a:b].tobytes(), _planes(pos[a:b])))
        for i in range(0, len(rows), 32):
            columns = zip(*rows[i : i + 32], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], names)

    def run(batches):
        rank, mask = counts.value, np.uint64(len(counts.value) - 1)
        held, waiting = [], 0
        for batch in batches:
            for _, h, n in sets_of(batch.column(0), size):
                digests = _digest(h, n)
                owner = np.repeat(np.arange(len(n)), n)
                h = h[np.lexsort((h, rank[(h & mask).astype(np.int64)], owner))]
                pos = np.arange(len(h)) - np.repeat(_starts(n), n) + 1
                keep = prefix_length(n, over)
                within = pos <= np.repeat(keep, n)
                held.append((digests, n, np.minimum(keep, n), h[within], pos[within]))
                waiting += len(held[-1][3])
                if waiting >= HELD:
                    yield from flushed(held)
                    held, waiting = [], 0
        if held:
            yield from flushed(held)

    return run


def prefix_length(n: np.ndarray, over: float) -> np.ndarray:
    """Elements of a set of n of which a set that similar holds one: similarity t needs t * n shared ones."""
    return (n - np.ceil(n * over - SLACK) + 1).astype(np.int64)


def possible(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, over: float) -> np.ndarray:
    """Sizes alike, and enough of both sets left from the shared element on; holds at the first one that similar sets share."""
    alike = (m >= n * over - SLACK) & (n >= m * over - SLACK)
    return alike & (1 + np.minimum(n - p, m - q) >= (n + m) * (over / (1 + over)) - SLACK)


MET = "h long, a long, b long, n int, pos int"


def _meeting(over: float, small: int | None):
    """Of packed rows sorted by part: pairs (a, b) of sets that share an element of both prefixes and pass the filters.

    Elements of more than `small` sets, if it is given, make pairs with their first set only and come out themselves, a row a set.
    """
    names = [c.split()[0] for c in MET.split(", ")]

    def pairs_of(found) -> pa.RecordBatch:
        ab = np.unique(np.concatenate(found), axis=0).view(np.int64)
        none = pa.nulls(len(ab))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1])), none.cast(pa.int32()), none.cast(pa.int32())], names)

    def met(part: int, rows: list):
        lengths = np.concatenate([_unplaned(r[2]) for r in rows])
        x = np.repeat(np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]), lengths)
        n = np.repeat(np.concatenate([_unplaned(r[1]) for r in rows]), lengths)
        h = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
        pos = np.concatenate([_unplaned(r[4]) for r in rows])
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) > 1 else order[:0]
        order = order[np.lexsort((x[order], h[order]))]
        h, x, n, pos = h[order], x[order], n[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])  # copies of a set come from several tasks
        h, x, n, pos = h[new], x[new], n[new], pos[new]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(h)))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(h)) - 1  # rows of the group behind each
        found, waiting = [], 0

        def fitting(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fits = possible(n[i], pos[i], n[j], pos[j], over)
            return np.stack((x[i[fits]], x[j[fits]]), 1)

        crowded = np.repeat(sizes > small, sizes) if small else np.zeros(len(h), bool)
        if crowded.any():
            lead = np.repeat(starts, sizes)
            others = np.flatnonzero(crowded & (lead != np.arange(len(h))))
            found.append(fitting(lead[others], others))
            waiting += len(found[-1])
            key = (np.int64(part) << 32) | h[crowded].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[crowded].view(np.int64)), pa.nulls(len(key)).cast(pa.int64()), pa.array(n[crowded].astype(np.int32)), pa.array(pos[crowded].astype(np.int32))], names)
        i, step = np.flatnonzero(~crowded & (left > 0)), 1
        while len(i):
            for a in range(0, len(i), FLUSH):
                found.append(fitting(i[a : a + FLUSH], i[a : a + FLUSH] + step))
                waiting += len(found[-1])
                if waiting >= FLUSH:
                    yield pairs_of(found)
                    found, waiting = [], 0
            step += 1
            i = i[left[i] >= step]
        if waiting:
            yield pairs_of(found)

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for p, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and rows:
                    yield from met(part, rows)
                    rows = []
                part = p
                rows.append(blobs)
        if rows:
            yield from met(part, rows)

    return run


def met_in_prefixes(texts: DataFrame, size: int, over: float, small: int | None = None) -> DataFrame:
    """(h, a, b, n, pos): see `_meeting`; a and b are digests, a pair may come several times."""
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(element_counts(texts, size))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.select("_ts").mapInArrow(_packing(size, over, counts, parts), PACKED)
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meeting(over, small), MET)


PAIR = ("a_set", "a_size", "b_set", "b_size")


def by_name(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(a_set, a_size, b_set, b_size) of pairs of digests, once each, the smaller name first."""
    left, right = (heads.select(F.col("_x").alias(s), F.struct("set_id", "size").alias(f"_{s}")) for s in "ab")
    named = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    first, second = F.least("_a", "_b"), F.greatest("_a", "_b")
    return named.select(first["set_id"].alias("a_set"), first["size"].alias("a_size"), second["set_id"].alias("b_set"), second["size"].alias("b_size")).distinct()


def _near(over: float):
    """Keeps the pairs whose bitmaps differ in no more bits than similar sets of these sizes differ in elements."""

    def run(batches):
        for batch in batches:
            both = batch.column(1).to_numpy() + batch.column(3).to_numpy()
            most = both - 2 * both * (over / (1 + over)) + 1e-6
            keep = []
            for left, right, d in zip(batch.column(4), batch.column(5), most, strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                keep.append(bool(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum() <= d))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:4]], [*PAIR])

    return run


def near(pairs: DataFrame, heads: DataFrame, over: float) -> DataFrame:
    """The pairs that their bitmaps do not exclude. What a bitmap tells is a lower bound, so no similar pair is lost."""
    left, right = (heads.select(F.col("set_id").alias(f"{s}_set"), F.col("_odd").alias(f"_{s}")) for s in "ab")
    met = pairs.join(left, "a_set").join(right, "b_set").select(*PAIR, "_a", "_b")
    kind = heads.schema["set_id"].dataType.simpleString()
    return cut_lineage(met.mapInArrow(_near(over), f"a_set {kind}, a_size long, b_set {kind}, b_size long"))


def _flagged(wanted):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value[batch.column(2).to_numpy()]))
            for a in range(0, len(batch), ROWS):
                yield pa.RecordBatch.from_arrays(batch.slice(a, ROWS).columns[:2], ["_k", "_ts"])

    return run


def _sharing(size: int):
    """Of the texts and then the pairs of a block, block by block: the pairs with the number of elements they share."""

    def run(batches):
        block, sets = None, {}
        for batch in batches:
            texts = batch.column(6)
            is_set = texts.is_valid().to_numpy(zero_copy_only=False)
            made = iter([x for _, h, n in sets_of(texts.filter(pa.array(is_set)), size) for x in np.split(h, np.cumsum(n)[:-1])])
            found, shared = [], []
            for i, (of, a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if of != block:
                    block, sets = of, {}
                if is_set[i]:
                    sets[a] = next(made)
                    continue
                x, y = sorted((sets[a], sets[b]), key=len)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                found.append(i)
                shared.append(int((y[at] == x).sum()))
            pairs = batch.take(pa.array(found, pa.int64())).columns[2:6]
            yield pa.RecordBatch.from_arrays([*pairs, pa.array(shared, pa.int64())], [*PAIR, "shared"])

    return run


def in_blocks(pairs: DataFrame) -> DataFrame:
    """The pairs with `block`: sets that pair with each other fall into few blocks, of at most about 2 * BLOCK_SETS sets.

    A pair goes with the smallest name that its first set pairs with. The sets of a large group are dealt out by hash,
    and a block has the pairs between two parts.
    """
    both = pairs.select(F.col("a_set").alias("_v"), F.col("b_set").alias("_u")).union(pairs.select("b_set", "a_set"))
    label = both.groupBy("_v").agg(F.least("_v", F.min("_u")).alias("_l")).withColumnRenamed("_v", "a_set")
    placed = pairs.join(label, "a_set")
    crowds = placed.select("_l", "a_set").union(placed.select("_l", "b_set")).distinct().groupBy("_l").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("_c"))
    of = [F.pmod(F.xxhash64(s), F.col("_c")) for s in ("a_set", "b_set")]
    return placed.join(crowds, "_l").select(F.xxhash64("_l", F.least(*of), F.greatest(*of)).alias("block"), *PAIR)


def _flag(key: str):
    return F.xxhash64(key).bitwiseAND((1 << FLAG_BITS) - 1).cast("int")


def similar(pairs: DataFrame, texts: DataFrame, heads: DataFrame, size: int, over: float) -> DataFrame:
    """The pairs with `shared` and `similarity`, if it is above `over`.

    Texts of pairs that may be similar are moved, and few others: they are smaller than their sets.
    """
    rows = cut_lineage(in_blocks(near(pairs, heads, over)))
    names = rows.select(_flag("a_set").alias("f")).union(rows.select(_flag("b_set").alias("f"))).distinct().toArrow()
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[names.column("f").to_numpy()] = True
    wanted = texts.sparkSession.sparkContext.broadcast(flags)
    kind = texts.schema["_k"].dataType.simpleString()
    some = texts.select("_k", "_ts", _flag("_k").alias("_f")).mapInArrow(_flagged(wanted), f"_k {kind}, _ts array<string>")
    needed = rows.select("block", F.col("a_set").alias("_k")).union(rows.select("block", "b_set")).distinct()
    none = F.lit(None)
    sets = needed.join(some, "_k").select("block", F.lit(0).alias("turn"), F.col("_k").alias("a_set"), none.cast("long").alias("a_size"), none.cast(kind).alias("b_set"), none.cast("long").alias("b_size"), "_ts")
    met = sets.unionByName(rows.select("block", F.lit(1).alias("turn"), *PAIR, none.cast("array<string>").alias("_ts")))
    met = met.repartition("block").sortWithinPartitions("block", "turn")
    scored = met.mapInArrow(_sharing(size), f"a_set {kind}, a_size long, b_set {kind}, b_size long, shared long")
    scored = scored.withColumn("similarity", F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared")))
    return cut_lineage(scored.where(F.col("similarity") > over))

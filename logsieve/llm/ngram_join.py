"""Documents linked by the Jaccard similarity of their word n-grams: prefix filtering with the rarest n-grams first.

Sets are sorted 64-bit hashes. The order of n-grams is by how often they are counted over all documents and then by hash;
counts are kept in 2**sketch_bits buckets, so what is sent to the tasks has a fixed size at any scale. The order only
decides how many candidates there are, never which links are found. Which documents a round of verification needs is sent
as 2**id_bits flags by hashed id, again of fixed size: a document that is flagged by chance costs time and nothing else.

The suffix filter bounds the difference of two sets from below: each set has a bitmap of the parity of its elements by
bucket, and sets differ in at least as many elements as their bitmaps differ in bits. A few words of it go with the rows
of a group, the whole bitmap (about two bits an element) is compared before any set is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.store import written
from logsieve.operators.overlap import connected_components

COUNT_ROWS = 1 << 14  # bucket counts are handed over in batches of so many
SIGN_BITS = 256  # of the bitmap that goes with the rows of a group, in words of 64
SIGNS = [f"sign{i}" for i in range(SIGN_BITS // 64)]
ROWS = 1000  # rows with long values are handed over in batches of so many
FLUSH = 1 << 17  # pairs held before they are handed over
ORDERS = 8  # of sets, a power of two: a group's first set is that of one of so many orders, chosen by its n-gram


def prefix_length(n: np.ndarray | int, percent: int):
    """Elements of a set of n of which a set as similar as that must hold one."""
    return n - (percent * n + 99) // 100 + 1


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Common elements that sets of these sizes have at least if 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def parity_bitmap(h: np.ndarray) -> np.ndarray:
    """Bytes whose bits tell whether an odd number of elements fall into a bucket; at least SIGN_BITS buckets, 2 to 4 an element."""
    bits = max(SIGN_BITS, 1 << (2 * len(h) - 1).bit_length()) if len(h) else SIGN_BITS
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer buckets, in so many bytes."""
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def most_different(n, m, percent: int):
    """Elements in one of two sets of these sizes only, at most, if they are similar."""
    return n + m - 2 * least_overlap(n, m, percent)


def _bucket_counts(width: int, bits: int):
    def run(batches):
        from logsieve.llm.words import shingle_sets

        counts = np.zeros(1 << bits, np.int64)
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width))
            for first in range(0, len(sets), 512):
                counts += np.bincount((np.concatenate(sets[first : first + 512]) & mask).astype(np.int64), minlength=1 << bits)
        bucket = np.flatnonzero(counts)
        for first in range(0, len(bucket), COUNT_ROWS):
            some = bucket[first : first + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """Elements of all sets by bucket. A task hands over the buckets that it met only; at most 2**bits sums come back."""
    met = texts.mapInArrow(_bucket_counts(width, bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[met.column("bucket").to_numpy()] = met.column("n").to_numpy()
    return out


def _id_bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    from logsieve.llm.words import BASE, mix

    return (mix(ids.astype(np.uint64) * BASE) >> np.uint64(64 - bits)).astype(np.int64)


def id_flags(ids: DataFrame, bits: int) -> np.ndarray:
    """Which of 2**bits buckets hold an id: each bucket comes to the driver once."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_id_bucket(batch.column(0).to_numpy(), bits)), pa.int32())], ["bucket"])

    out = np.zeros(1 << bits, bool)
    out[ids.mapInArrow(run, "bucket int").distinct().toArrow().column("bucket").to_numpy()] = True
    return out


def _sizes(width: int):
    def run(batches):
        from logsieve.llm.words import shingle_sets

        for batch in batches:
            sizes, digests, bitmaps, signs = [], [], [], []
            for h in shingle_sets(batch.column(1), width):
                bitmap = parity_bitmap(h)
                sizes.append(len(h))
                digests.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                bitmaps.append(bitmap.tobytes())
                signs.append(folded(bitmap, SIGN_BITS // 8))
            signs = np.array(signs, np.uint8).reshape(len(sizes), -1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary()), *map(pa.array, np.ascontiguousarray(signs.T))],
                ["id", "n", "digest", "bitmap", *SIGNS],
            )

    return run


def _prefixes(width: int, percent: int, bits: int, counts):
    def run(batches):
        from logsieve.llm.words import shingle_sets

        rank, mask = counts.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            sizes, prefixes = [], []
            for h in shingle_sets(batch.column(1), width):
                order = np.lexsort((h, rank[(h & mask).astype(np.int64)]))
                sizes.append(len(h))
                prefixes.append(h[order[: prefix_length(len(h), percent)]].tobytes() if len(h) else b"")
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary())], ["id", "n", "prefix"])
            yield from (out.slice(i, ROWS) for i in range(0, len(out), ROWS))

    return run


def _prefix_rows(batches):
    """(h, set, n, pos): a row per prefix element."""
    for batch in batches:
        keys, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        blobs = batch.column(2).to_pylist()
        for first in range(0, len(blobs), 1000):
            part = blobs[first : first + 1000]
            counts = np.array([len(b) // 8 for b in part])
            starts = np.repeat(np.cumsum(counts) - counts, counts)
            h = np.frombuffer(b"".join(part), np.int64)
            if len(h):
                columns = [h, np.repeat(keys[first : first + 1000], counts), np.repeat(sizes[first : first + 1000], counts).astype(np.int32), (np.arange(len(h)) - starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "set", "n", "pos"])


def possible(n, p, m, q, percent: int) -> np.ndarray:
    """Length and positional filter: sizes n and m, places p and q of a common element in the two orders."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (1 + np.minimum(n - p - 1, m - q - 1) >= least_overlap(n, m, percent))


SHARED = "h long, set long, n int, pos int, first long"


def _shared(percent: int):
    """Of rows sorted by h: those whose h comes again, with the group's first set as candidate partner.

    `first` is null where the filters exclude that partner. Works over batches with one row kept.
    """

    def run(batches):
        head = None  # (h, set, n, pos) of the first row of the group that the last batch ended in, and whether it was emitted
        for batch in batches:
            h, s, n, p = (batch.column(i).to_numpy() for i in range(4))
            if not len(h):
                continue
            if head is not None and not head[4]:  # the single row so far of its group comes along
                h, s, n, p = (np.concatenate(([x], y)) for x, y in zip(head[:4], (h, s, n, p), strict=True))
                n, p = n.astype(np.int32), p.astype(np.int32)
                known = None
            else:
                known = head
            new = np.concatenate(([known is None or known[0] != h[0]], h[1:] != h[:-1]))
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            sizes = np.diff(np.append(starts, len(h))) if len(starts) else np.zeros(0, np.int64)
            # leader of each row; rows before the first start belong to the group known from the last batch
            lead_s, lead_n, lead_p = (np.where(group >= 0, x[starts[np.maximum(group, 0)]] if len(starts) else x, k) for x, k in zip((s, n, p), known[1:4] if known else (0, 0, 0), strict=True))
            again = np.where(group >= 0, sizes[np.maximum(group, 0)] > 1 if len(starts) else True, True)
            is_head = np.zeros(len(h), bool)
            is_head[starts] = True
            fits = ~is_head & (lead_s != s) & possible(lead_n.astype(np.int64), lead_p.astype(np.int64), n.astype(np.int64), p.astype(np.int64), percent)
            if len(starts):
                last = starts[-1]
                head = (h[last], s[last], n[last], p[last], bool(sizes[-1] > 1))
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[again]), pa.array(s[again]), pa.array(n[again]), pa.array(p[again]), pa.array(lead_s[again], mask=~fits[again])], ["h", "set", "n", "pos", "first"])

    return run


def _crossing(percent: int, block: int):
    """Of rows sorted by (h, n, set) with their component: pairs of one h from different components that pass the filters."""

    def pairs(left, right) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(left[0]), block):
            s, n, p, c, k, u = (x[i : i + block] for x in left)
            for j in range(0, len(right[0]), block):
                t, m, q, d, o, v = (x[j : j + block] for x in right)
                a, b = np.nonzero((c[:, None] != d[None]) & possible(n[:, None], p[:, None], m[None], q[None], percent))
                apart = np.bitwise_count(u[a] ^ v[b]).sum(1, dtype=np.int64)
                fits = (apart <= most_different(n[a], m[b], percent)) | ~(k[a] & o[b])  # an id of several texts has no sign
                if fits.any():
                    yield s[a][fits], t[b][fits]

    def batch_of(found) -> pa.RecordBatch:
        x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["a", "b"])

    def run(batches):
        current, held = None, []
        found, waiting = [], 0
        for batch in batches:
            h, s, n, p, c = (batch.column(i).to_numpy() for i in range(5))
            signs = np.stack([batch.column(i).to_numpy() for i in range(6, 6 + len(SIGNS))], 1).view(np.uint64)
            row = (s, n.astype(np.int64), p.astype(np.int64), c, batch.column(5).to_numpy(zero_copy_only=False), signs)
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
                if h[a] != current:
                    current, held = h[a], []
                own = tuple(x[a:b] for x in row)
                others = [*held, own] if b - a > 1 and (own[3] != own[3][0]).any() else held
                for other in others:
                    for x in pairs(other, own):
                        found.append(x)
                        waiting += len(x[0])
                        if waiting >= FLUSH:
                            yield batch_of(found)
                            found, waiting = [], 0
                held = [*held, own] if b == len(h) else []
        if found:
            yield batch_of(found)

    return run


def _near(percent: int):
    """Keeps (a, b) whose bitmaps do not differ in more bits than similar sets of these sizes may."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = most_different(n, m, percent)
            keep = np.zeros(batch.num_rows, bool)
            for i, (left, right) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(left.as_buffer(), np.uint8), np.frombuffer(right.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                keep[i] = np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum() <= most[i]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _full_sets(width: int, wanted, bits: int):
    """The sets of the documents whose bucket is wanted: all that are needed and a few more."""

    def run(batches):
        from logsieve.llm.words import shingle_sets

        for batch in batches:
            batch = batch.filter(pa.array(wanted.value[_id_bucket(batch.column(0).to_numpy(), bits)]))
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                blobs = [h.tobytes() for h in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["set", "elements"])

    return run


def _verify(percent: int):
    """Keeps (a, b) whose sets are similar, by their exact intersection."""

    def run(batches):
        for batch in batches:
            keep = []
            last, x = None, None
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                blob = left.as_buffer()
                if last is None or not blob.equals(last):
                    last, x = blob, np.frombuffer(blob, np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                need = int(least_overlap(len(x), len(y), percent))
                if min(len(x), len(y)) < need:
                    keep.append(False)
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                keep.append(int((x[at] == y).sum()) >= need)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return run


def jaccard_join(
    docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = 18, block: int = 512, id_bits: int = 20
) -> DataFrame:
    """One row per document: the id column, n_shingles and component_id (the smallest id reachable by links).

    Two documents link if 100 * intersection >= percent * union of their sets of distinct n-grams of words (A-Z as a-z);
    fewer words than `width` are one n-gram. No words, empty or null text: an empty set, linked with nothing. Rows whose id
    is null are left out; rows of one id count as one document whose texts are linked. Other columns are ignored. An empty
    table gives no rows. Ids must be integers. Only components are computed: links within a component need not all be
    verified, so there is no number of links.

    Equal sets become one (`min` id). Each set's rarest elements, as many as the threshold demands, are its prefix; sets
    that share a prefix element and pass the length and positional filter are candidates, each pair verified once, after a
    suffix filter. To keep a group of m near copies from making m * m / 2 pairs, candidates come in two rounds: first every
    set with the first set of each group it is in (first in one of ORDERS pseudo-random orders, so that near copies meet
    a few common partners), then only pairs that these links left in different components; a pair within a component
    could not change the result. Groups are read as sorted streams, and only a group that lies in several components is
    held, in blocks.
    """
    id_ = F.col(f"`{id_col}`").cast("long")
    source = docs.where(id_.isNotNull()).select(id_.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(bucket_counts(source.select("text"), width, sketch_bits))
    sets = written(source.mapInArrow(_sizes(width), ", ".join(["id long, n long, digest binary, bitmap binary", *[f"{c} long" for c in SIGNS]])), "sets")
    classes = written(sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("set"), *[F.min(c).alias(c) for c in SIGNS]), "classes")
    prefixes = source.mapInArrow(_prefixes(width, percent, sketch_bits, counts), "id long, n long, prefix binary")
    heads = prefixes.join(classes.select(F.col("set").alias("id")).hint("shuffle_hash"), "id", "left_semi")
    rows = heads.mapInArrow(_prefix_rows, "h long, set long, n int, pos int").repartition("h")
    rows = rows.withColumn("turn", F.xxhash64("set", F.col("h").bitwiseAND(ORDERS - 1))).sortWithinPartitions("h", "turn", "set").drop("turn")
    shared = written(rows.mapInArrow(_shared(percent), SHARED), "shared")

    def members_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()

    def near(pairs: DataFrame) -> DataFrame:
        members = members_of(pairs)
        signed = written(sets.join(members, "id", "left_semi").select("id", "n", "bitmap").distinct(), "bitmaps")
        left, right = (signed.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bitmap_{k}")) for k in "ab")
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
        return written(met.mapInArrow(_near(percent), "a long, b long").distinct(), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        members = members_of(pairs)
        wanted = spark.sparkContext.broadcast(id_flags(members, id_bits))
        full = written(source.mapInArrow(_full_sets(width, wanted, id_bits), "set long, elements binary"), "members")
        left, right = (full.select(F.col("set").alias(k), F.col("elements").alias(f"elements_{k}")) for k in "ab")
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "elements_a", "elements_b")
        return written(met.mapInArrow(_verify(percent), "u long, v long"), "links")

    first = shared.where(F.col("first").isNotNull()).select(F.least("first", "set").alias("a"), F.greatest("first", "set").alias("b")).distinct()
    first = written(first, "pairs")
    links = verified(near(first))
    found = connected_components(links)
    known = classes.join(found, F.col("set") == F.col("node"), "left").groupBy("set").agg(F.min(F.coalesce("component", "set")).alias("component"), *[F.min(c).alias(c) for c in SIGNS], (F.count(F.lit(1)) == 1).alias("signed"))
    placed = shared.join(known, "set").select("h", "set", "n", "pos", "component", "signed", *SIGNS)
    mixed = placed.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") < F.col("most")).select("h")
    groups = placed.join(mixed, "h", "left_semi").repartition("h").sortWithinPartitions("h", "n", "set")
    crossing = groups.mapInArrow(_crossing(percent, block), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(near(written(crossing, "pairs"))))
    components = connected_components(links)
    by_class = classes.join(components, F.col("set") == F.col("node"), "left").select("digest", F.coalesce("component", "set").alias("component_id"))
    return sets.join(by_class, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

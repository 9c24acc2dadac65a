"""Product codes of vectors: codebooks by ball k-means in whole numbers, exact and the same on any cluster.

A vector's components become whole numbers and its parts are coded on their own. A round is one pass over the vectors, which
keep the entry that each part had before. Under the moved entries a part at distance d from its own entry can only go to
entries within 2 d of it: half the way to the nearest other entry bounds the stable core, whose parts stay without a
comparison, and around it lie rings, each with one more of the entries by distance as candidate. An entry's ball, out to its
furthest part, bounds the neighbours of all its parts; where neither it nor a neighbour moved, the whole ball stays. All
comparisons are between squares of whole numbers, so nothing is rounded. The tasks hand back sums per entry; only
codebooks (entries x components) are ever in the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.store import written

SCALE = 1024
BLOCK_BYTES = 1 << 24  # vectors are taken through the codebooks in blocks of about so many bytes
BROADCAST_LABELS = 10_000  # sums of up to so many labels are sent to all tasks; more are joined with salt
SALTS = 32


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x)."""
    scaled = np.floor(x.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**31:
        raise OverflowError("components of 2**21 and more can't be coded: their squared distances don't fit into a long")
    return scaled.astype(np.int64)


def exact_type(points: np.ndarray, book: np.ndarray):
    """float64 where all sums of a squared distance are whole numbers below 2**53, else int64."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    bound = 16 * most * most * max(1, points.shape[1])
    if bound >= 1 << 62:
        raise OverflowError("the squared distances don't fit into a long")
    return np.float64 if bound < 1 << 53 else np.int64


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * (points @ book.T) + (book * book).sum(1)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance); ties to the lower index."""
    d = squares(points, book)
    at = d.argmin(1)
    return at, d[np.arange(len(points)), at]


class Balls:
    """A codebook with what its entries' distances tell: the order of the others around each, and which entries moved."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None = None):
        self.book = book
        self.moved = np.ones(len(book), bool) if before is None else (book != before).any(1)
        exact = book.astype(exact_type(book, book))
        between = squares(exact, exact)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, 1)
        self.compared = 0  # parts x candidates

    def assign(self, points: np.ndarray, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, given the entry that it held under the codebook before."""
        kind = exact_type(points, self.book)
        points, book = points.astype(kind), self.book.astype(kind)
        if held is None:
            self.compared += len(points) * len(book)
            return nearest(points, book)
        step = points - book[held]
        own = (step * step).sum(1)
        at = held.copy()
        by_entry = np.argsort(held, kind="stable")
        bounds = np.searchsorted(held[by_entry], np.arange(len(book) + 1))
        for entry in np.flatnonzero(np.diff(bounds)):
            ball = by_entry[bounds[entry] : bounds[entry + 1]]
            around = self.between[entry]
            neighbours = int(np.searchsorted(around, 4 * own[ball].max(), "right"))
            if not self.moved[self.order[entry, :neighbours]].any():
                continue
            ring = np.searchsorted(around[:neighbours], 4 * own[ball], "right")  # candidates of a part, its own entry included
            beyond = ring > 1
            ball, ring = ball[beyond], ring[beyond]
            low = 1
            while low < neighbours and len(ball):
                high = min(2 * low, neighbours)
                here = (ring > low) & (ring <= high)
                if here.any():
                    some, candidates = ball[here], np.sort(self.order[entry, :high])
                    self.compared += len(some) * high
                    place, own[some] = nearest(points[some], book[candidates])
                    at[some] = candidates[place]
                low = high
        return at, own


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector is there with finite components only, lengths of all)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    usable = column.is_valid().to_numpy(zero_copy_only=False).copy()
    parents = pc.list_parent_indices(column)
    bad = pc.invert(pc.fill_null(pc.is_finite(pc.list_flatten(column)), False))
    usable[np.unique(parents.filter(bad).to_numpy())] = False
    return usable, lengths


def _reading(names: Sequence[str]):
    """Id, label and whole numbers of the rows that are kept."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            usable, _ = _numbers(column)
            rows = batch.filter(pa.array(usable))
            column = rows.column(2)
            flat = whole_numbers(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64))
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], names)

    return run


def _blocks(batches):
    """Batches put together until they are large enough."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of this length, their numbers)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.equal(pc.list_value_length(column), width)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    return rows, pc.list_flatten(column.filter(fits)).to_numpy().reshape(len(rows), width)


def _assigning(books: np.ndarray, before: np.ndarray | None, names: Sequence[str], final: bool):
    """Rows with the entries of their parts (final: as hex digits, with the error), null where the length is another."""
    parts, _, width = books.shape

    def run(batches):
        balls = [Balls(books[p], None if before is None else before[p]) for p in range(parts)]
        for block in _blocks(batches):
            rows, numbers = _matrix(block.column(2), parts * width)
            held = None
            if before is not None:
                held = np.frombuffer(b"".join(block.column(3).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                at, squared = balls[p].assign(numbers[:, p * width : (p + 1) * width], None if held is None else held[:, p])
                codes[:, p], error = at, error + squared.astype(np.int64)
            digits = [None] * block.num_rows
            for row, code in zip(rows.tolist(), codes, strict=True):
                digits[row] = code.tobytes().hex() if final else code.tobytes()
            arrays = [block.column(0), block.column(1)]
            if final:
                errors = [None] * block.num_rows
                for row, e in zip(rows.tolist(), error.tolist(), strict=True):
                    errors[row] = e
                arrays += [pa.array(digits, pa.string()), pa.array(errors, pa.int64())]
            else:
                arrays += [block.column(2), pa.array(digits, pa.binary())]
            yield from pa.table(arrays, names=list(names)).to_batches()

    return run


def _summing(parts: int, entries: int, width: int):
    """Per task one row for each part and entry that has members: their number and the sums of their components."""
    names = ["part", "entry", "members", "sums"]

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for block in _blocks(batches):
            rows, numbers = _matrix(block.column(0), parts * width)
            codes = np.frombuffer(b"".join(block.column(1).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], numbers[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names)

    return run


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts x entries x width: the parts of the `entries` smallest ids (null ids last, equal ids by vector) of one length.

    The length is that of the smallest id whose vector can be cut into equal parts; None if there is no such vector.
    """
    whole = rows.where((F.size("numbers") > 0) & (F.size("numbers") % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("numbers")]
    first = whole.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0]["numbers"])
    chosen = whole.where(F.size("numbers") == length).orderBy(*order).limit(entries).collect()
    book = np.array([r["numbers"] for r in chosen], np.int64)
    return book.reshape(len(book), parts, length // parts).transpose(1, 0, 2)


def moved_books(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """Every entry replaced by floor(sum / number) of its members' components; entries without members stay."""
    parts, entries, width = books.shape
    partial = state.select("numbers", "held").mapInArrow(_summing(parts, entries, width), "part int, entry int, members long, sums array<long>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("members").alias("members"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["members"] for i in range(width)]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Rows with label_error: the errors summed over equal labels, nulls together."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("of_label")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("of_salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("of_salt") == F.col("salt"))).drop("of_label", "salt", "of_salt")


def encode(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: the id column, code, error, label_error and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped. Components become floor(1024 x). Codebooks start
    as the parts of the `entries` smallest ids (null ids last, equal ids by vector; all, if there are fewer) and are moved `rounds` times: each
    part goes to its nearest entry (ties to the lower index), each entry with members to floor(sum / number) of them. code: the final
    entries of the parts, two hex digits each; error: the sum of their squared distances. Repeated rows are coded alike. A kept
    vector that can't be cut like those of the codebooks (another length, or none that divides into `parts`) has null code
    and error, which count for nothing. label_error sums the errors of equal labels, nulls together. Further columns are ignored; an empty
    table gives no rows. Components of 2**21 and more raise an error, since squared distances would not fit into a long.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("numbers"))
    kinds = f"id {source.schema['id'].dataType.simpleString()}, label {source.schema['label'].dataType.simpleString()}"
    rows = written(source.mapInArrow(_reading(["id", "label", "numbers"]), f"{kinds}, numbers array<long>"), "numbers")
    books, before = first_books(rows, parts, entries), None
    if books is None:
        none = rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return with_label_errors(none).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(np.zeros(0, np.int64))).alias("codebooks_sha256"))
    for turn in range(rounds):
        names = ["id", "label", "numbers", "held"]
        rows = written(rows.mapInArrow(_assigning(books, before, names, False), f"{kinds}, numbers array<long>, held binary"), f"round-{turn}")
        books, before = moved_books(books, rows), books
    coded = written(rows.mapInArrow(_assigning(books, before, ["id", "label", "code", "error"], True), f"{kinds}, code string, error long"), "codes")
    return with_label_errors(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

"""Packing of token sequences by the sum of squares of open windows per gap.

Texts are tokenized where they lie; from then on only one short row per piece moves. Pieces of a full window need no
place. The others are dealt out by a hash of their row into groups of about `group_rows`, so that every group has the lengths of
the whole corpus whatever the order of the documents, and each group is packed in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.store import written

ROWS_PER_TASK = 1 << 33  # a task's pieces are numbered from its partition number times this
FIELDS = (("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("row", "long"))


class GapCounts:
    """Open windows by gap; `place` chooses the gap whose use leaves the smallest sum of squared counts.

    Using a window of gap g for a length s changes the sum by 2 (count[g - s] - count[g]) + 2, or by 1 - 2 count[g] where it
    gets full, since full windows are not open; a new window by 2 count[size - s] + 1. With `count[0]` held at -1/2 the first
    two are one formula, and half of each change less one is compared. Of equal gaps the smallest is taken, and an open
    window before a new one. `reluctant`: a new window is made only where no open one has room.
    """

    def __init__(self, size: int, reluctant: bool):
        self.size, self.reluctant = size, reluctant
        self.count = np.zeros(size + 1)
        self.count[0] = -0.5
        self.gain = np.full(size + 1, np.inf)  # -count where there are windows
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a length below the size."""
        room = self.size - length
        change = self.count[:room] + self.gain[length : self.size]
        at = int(change.argmin())
        best = change[at]
        if best < np.inf and (self.reluctant or best <= self.count[room] - 0.5):
            gap = length + at
            window = self.windows[gap].pop()
            self._set(gap, self.count[gap] - 1)
        else:
            gap, window = self.size, self.made
            self.made += 1
        left = gap - length
        if left:
            self.windows[left].append(window)
            self._set(left, self.count[left] + 1)
        return window, self.size - gap

    def _set(self, gap: int, count: float) -> None:
        self.count[gap] = count
        self.gain[gap] = -count if count else np.inf


def place_all(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, in their order, by whichever of two runs needs fewer windows.

    One takes the lengths as they come and makes a new window whenever that is the best place; the other takes the longest
    first (equal ones as they come) and makes a new window only where none has room.
    """
    plain = GapCounts(size, reluctant=False)
    places = [plain.place(n) for n in lengths]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = GapCounts(size, reluctant=True)
    found = [falling.place(lengths[i]) for i in order]
    if falling.made <= plain.made:
        for i, place in zip(order, found, strict=True):
            places[i] = place
    return places


def _cutting(tokenizer_path: str, id_type: pa.DataType, window: int, end_id: int):
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", *(name for name, _ in FIELDS)]

    def run(batches):
        from pyspark import TaskContext

        from logsieve.llm.encoding import encoder

        ids_of = encoder(tokenizer_path).ids
        row = TaskContext.get().partitionId() * ROWS_PER_TASK
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = []
            for n, key in enumerate(batch.column(0).to_pylist()):
                ids = ids_of(batch.column(1)[n].as_py() or "") + end
                total = len(ids) // 4
                start = 0
                for piece in range(-(-total // window)):
                    stop = start + (total - start - 1) % window + 1
                    out.append((key, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), row))
                    start, row = stop, row + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _placing(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        places = place_all(rows["length"].tolist(), window)
        first: dict[int, int] = {}  # a window is named by the smallest row in it
        for row, (number, _) in zip(rows["row"].tolist(), places, strict=True):
            first.setdefault(number, row)
        return rows.assign(sequence_id=[first[number] for number, _ in places], offset=[offset for _, offset in places]).drop(columns="row")

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    group_rows: int = 1 << 14,
) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32, sequence_id and offset.

    A text is its ids followed by `end_id`; null and empty texts are that id alone. A text of more than `window` ids is cut into
    pieces of `window`, the first of which may be shorter; no other text is cut. Full pieces are sequences of their own; the
    others are packed by `place_all` in groups of about `group_rows`. `group_rows` bounds the memory of a task; a group wastes a few
    windows at most beyond what its lengths need, so larger groups pack a little closer. A sequence's number is the smallest
    row number of its pieces; offsets are gapless from 0. Repeated rows and null ids are packed like any others; further
    columns, whatever their names, are ignored; an empty table gives no pieces.
    """
    kind = docs.schema[id_col].dataType
    arrow_type = {"long": pa.int64(), "integer": pa.int32()}.get(kind.typeName(), pa.string())
    id_type = "string" if arrow_type == pa.string() else kind.simpleString()
    columns = f"id {id_type}, " + ", ".join(f"{name} {t}" for name, t in FIELDS)
    source = docs.select(F.col(f"`{id_col}`").cast(id_type).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = written(source.mapInArrow(_cutting(tokenizer_path, arrow_type, window, end_id), columns), "pieces")
    full = pieces.where(F.col("length") == window)
    short = pieces.where(F.col("length") < window)
    groups = max(1, -(-short.count() // group_rows))
    placed_columns = columns.replace("row long", "sequence_id long, offset long")
    placed = short.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")).applyInPandas(lambda rows: _placing(window)(rows), placed_columns)
    full = full.withColumnRenamed("row", "sequence_id").withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(placed).withColumnRenamed("id", id_col)

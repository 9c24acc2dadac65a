"""Packing of token sequences into windows with bounded memory."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.store import written

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES_PER_TASK = 1 << 33  # a task's sequences are numbered from its partition number times this
MERGED = 1 << 62  # sequences made from leftovers are numbered from here


class OpenWindows:
    """A fixed number of open windows; `place` gives (window, offset) and hands out the fullest when none fits."""

    def __init__(self, size: int, open_windows: int | None, first_id: int):
        self.size, self.most, self.next_id = size, open_windows, first_id
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if self.most is not None and len(self.room) >= self.most:
                self.room.pop(0)  # the fullest is emitted
            free, window = self.size, self.new_id()
        if free > length:
            insort(self.room, (free - length, window))
        return window, self.size - free

    def open_ids(self) -> set[int]:
        return {window for _, window in self.room}


def _packing(tokenizer_path: str, id_type: pa.DataType, window: int, open_windows: int, end_id: int):
    names = ["id", *(x.split()[0] for x in PIECES.split(", ")), "open", "part"]

    def run(batches):
        from pyspark import TaskContext

        from logsieve.llm.encoding import encoder

        ids_of = encoder(tokenizer_path).ids
        part = TaskContext.get().partitionId()
        windows = OpenWindows(window, open_windows, part * SEQUENCES_PER_TASK)
        end, width = int(end_id).to_bytes(4, "little"), 4 * window
        held: dict[int, list[tuple]] = {}  # the pieces in windows that are still open

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == 0 else pa.bool_() if n == 7 else pa.int64()) for n, c in enumerate(zip(*rows, strict=True))], names)

        for batch in batches:
            out = []
            keys = batch.column(0).to_pylist()
            for n, key in enumerate(keys):
                ids = ids_of(batch.column(1)[n].as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * start + width]
                    length = len(piece) // 4
                    row = (key, start, length, zlib.crc32(piece), total)
                    if length == window:
                        out.append((*row, windows.new_id(), 0, False, part))
                    else:
                        sequence, offset = windows.place(length)
                        held.setdefault(sequence, []).append((*row, sequence, offset))
            alive = windows.open_ids()
            for sequence in [s for s in held if s not in alive]:
                out += [(*r, False, part) for r in held.pop(sequence)]
            if out:
                yield table(out)
        if held:
            yield table([(*r, True, part) for rows in held.values() for r in rows])

    return run


def _merging(window: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        windows = OpenWindows(window, None, MERGED + int(key[0]) * SEQUENCES_PER_TASK)
        places = [windows.place(int(n)) for n in rows["length"]]
        return rows.assign(sequence_id=[p[0] for p in places], offset=[p[1] for p in places]).drop(columns=["open", "part"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, open_windows: int = 64, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", merge_partitions: int = 64,
) -> DataFrame:
    """One row per piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A text is its ids followed by `end_id`; null and empty texts are that id alone. Runs of `window` ids are sequences of
    their own; the rest of each text goes, whole, to the open window of its partition that it fills best. Each partition
    keeps `open_windows` of them; when none has room, the fullest is emitted and a new one opened. The windows that are
    open at the end of `merge_partitions` partitions are merged: their pieces, at most `open_windows` x `window` of a
    partition, are packed again best-fit, longest first. Memory is bounded by the open windows and one batch of rows; no
    shuffle but that of the leftovers. Pieces of one sequence have gapless offsets from 0. Repeated rows and null ids
    are packed like any others; further columns are ignored; an empty table gives no pieces. The order of rows in a file
    split decides the places, so a task that is run again gives the same rows.
    """
    id_type = docs.schema[id_col].dataType
    arrow_type = pa.int64() if id_type.typeName() == "long" else pa.int32() if id_type.typeName() == "integer" else pa.string()
    if arrow_type == pa.string():
        id_type = "string"
    schema = f"id {id_type if isinstance(id_type, str) else id_type.simpleString()}, {PIECES}"
    source = docs.select(F.col(f"`{id_col}`").cast(id_type).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = written(source.mapInArrow(_packing(tokenizer_path, arrow_type, window, open_windows, end_id), f"{schema}, open boolean, part long"), "packed")
    done = placed.where(~F.col("open")).drop("open", "part")
    left = placed.where("open").groupBy((F.col("part") / merge_partitions).cast("long").alias("group")).applyInPandas(_merging(window), schema)
    return done.unionByName(left).withColumnRenamed("id", id_col)

"""Encoding by a SentencePiece merge model with seeded merge dropout, and decoding without loss."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.words import BASE, mix

MARK = "▁"  # how pieces write a blank
LETTERS, STOPS = "A-Za-zÀ-ɏ", ".,!"
SYMBOL_BITS = 21
PLACE = (1 << SYMBOL_BITS) - 1  # of a merge, which is written as rank and place
NONE = np.int64(1) << np.int64(60)
LONG = 200  # characters from which a part has an agenda of its own; shorter ones are segmented together
SHORT = 24  # characters up to which the segmentation of a part without skips is kept
MEMORY_BYTES = 64 << 20  # a worker forgets the segmentations when they take about so many bytes
KEPT_BYTES = 200  # of a part's entry in a dictionary; its arrays come on top
OCCURRENCES = 1 << 15  # looked up at once
DECODED = 100  # rows that are decoded together
CELLS = 1 << 16  # of the table of parts and places that are segmented together
NOTHING = (1 << SYMBOL_BITS) - 1  # in a cell without a symbol; makes no piece with any


class PieceModel:
    """The normal pieces of a model file with their scores, and its bytes for what has no piece."""

    def __init__(self, path: str):
        file = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(file.get_piece_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
        self.ids = {file.id_to_piece(i): i for i in normal}
        self.order = {file.id_to_piece(i): -file.get_score(i) for i in normal}
        self.byte_ids = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        texts = [b""] * file.get_piece_size()
        for piece, i in self.ids.items():
            texts[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            texts[i] = bytes([b])
        self.texts = pa.array(texts, pa.binary())

        self._pairs()

        self.part = self._parts()

    def _parts(self) -> re.Pattern:
        """Cuts a text where no piece can cross: before blanks, at line feeds and, if no piece holds a letter and a stop
        beside it, between these two."""
        crossing = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.S)
        if any(crossing.search(p) for p in self.ids):
            return re.compile(".+", re.S)
        if any(re.search(f"[{LETTERS}][{STOPS}]", p) for p in self.ids):
            return re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}")
        return re.compile(f" *(?:[^ \n{MARK}{STOPS}]+|(?<![{LETTERS}])[{STOPS}])+|[{STOPS}][^ \n{MARK}]*| +|\n|{MARK}")

    def _pairs(self) -> None:
        """Which two symbols make a piece, as a sorted table. A symbol is a piece, or else a character by its code."""
        size = self.first_character = len(self.texts)
        number = lambda x: self.ids.get(x, size + ord(x) if len(x) == 1 else None)
        rows = []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = number(piece[:cut]), number(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left << SYMBOL_BITS | right, i, int(self.order[piece])))
        rows.sort()
        self.pair_keys, self.pair_pieces, self.pair_ranks = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.slot_shift = np.uint64(62 - len(rows).bit_length())  # four slots and more for each pair
        slots = self._slots(self.pair_keys)
        self.slots = np.zeros(1 << (64 - int(self.slot_shift)), np.int32)
        self.slots[slots] = np.arange(len(rows))
        self.shared = np.bincount(slots, minlength=len(self.slots)) > 1
        self.characters = np.arange(size, size + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = i

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * BASE) >> self.slot_shift).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these symbols beside each other make a piece, and their rows in the table of pairs."""
        keys = left.astype(np.int64) << SYMBOL_BITS | right
        slots = self._slots(keys)
        found = self.slots[slots]
        hit = self.pair_keys[found] == keys
        rest = np.flatnonzero(self.shared[slots] > hit)
        if len(rest):
            found[rest] = np.minimum(np.searchsorted(self.pair_keys, keys[rest]), len(self.pair_keys) - 1)
            hit[rest] = self.pair_keys[found[rest]] == keys[rest]
        hit = np.flatnonzero(hit)
        return hit, found[hit]

    def symbol_ids(self, symbol: str) -> list[int]:
        found = self.ids.get(symbol)
        return [found] if found is not None else [self.byte_ids[b] for b in symbol.replace(MARK, " ").encode()]

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The text of each list of ids, the blank before it left out."""
        taken = self.texts.take(lists.flatten())
        if taken.null_count:
            raise ValueError("null among the ids of a text")
        _, offsets, data = taken.buffers()
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
        ends = np.frombuffer(offsets, np.int32)[ends].tolist() if len(taken) else [0] * len(ends)
        data = memoryview(data or b"")
        found = zip(lists.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True)
        return [str(data[a:b], "utf-8", "replace")[1:] if valid else None for valid, a, b in found]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class _Rows:
    """Rows of numbers, one after the other in one growing array."""

    def __init__(self, dtype):
        self.data, self.ends, self.n = np.empty(1024, dtype), np.zeros(1024, np.int64), 0

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        first, last = self.ends[self.n], self.ends[self.n] + len(values)
        if last > len(self.data):
            self.data = np.resize(self.data, 2 * last)
        if self.n + len(sizes) >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * (self.n + len(sizes) + 1))
        self.data[first:last] = values
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = first + np.cumsum(sizes)
        self.n += len(sizes)

    def gather(self, rows: np.ndarray, after=0) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows from place `after` on, and how many each has."""
        starts = self.ends[rows] + after
        sizes = self.ends[rows + 1] - starts
        return self.data[_places(starts, sizes)], sizes


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _taken(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These rows of values that lie one after the other, and how many each has."""
    return values[_places((np.cumsum(sizes) - sizes)[rows], sizes[rows])], sizes[rows]


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of parts, blanks as pieces write them, and how many each has."""
    codes = np.frombuffer("".join(parts).replace(" ", MARK).encode("utf-32-le"), np.int32)
    return codes, np.fromiter(map(len, parts), np.int64, len(parts))


class DropoutEncoder:
    """Merges in the order of an agenda, each candidate skipped with a probability decided by a keyed hash.

    The key is the draw of an occurrence: a hash of the seed, the text's key and the number of the part in the text; the hash
    covers the place in the part and the merged piece. So every occurrence of a word is segmented by skips of its own, and
    the same document always in the same way.

    A candidate that never comes up as the best of its agenda changes nothing if it is skipped. Of short parts the merges
    made without skips and the ids are therefore kept: an occurrence that skips none of these merges has these ids. The
    others in a group of texts are segmented together, each with its own skips: in each step every part takes the next
    candidate of its agenda (best score, then leftmost). So are longer parts, the longest of them one by one.
    """

    def __init__(self, model: PieceModel, dropout: float, seed: int, memory: int = MEMORY_BYTES):
        self.model, self.limit, self.memory = model, int(dropout * (1 << 32)), memory
        self.key = np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}".encode(), digest_size=8).digest(), "little"))
        self._forget()

    def _forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.codes, self.merges, self.ids = _Rows(np.int32), _Rows(np.int64), _Rows(np.int32)  # of the parts without skips
        self.held = 0  # bytes, about

    def _skipped(self, draws: np.ndarray, merges: np.ndarray) -> np.ndarray:
        """Whether these merges, each written as rank and place, are skipped by these draws."""
        x = (merges & PLACE).view(np.uint64)
        x *= BASE
        x += (merges >> SYMBOL_BITS).view(np.uint64)
        x ^= draws
        return mix(x) >> np.uint64(32) < self.limit

    def segment(self, part: str, draw: int) -> list[str]:
        """One part by an agenda of its own."""
        symbols = list(part)
        n = len(symbols)
        own = np.array([draw], np.uint64)
        order = self.model.order
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def propose(i: int, j: int) -> None:
            merged = symbols[i] + symbols[j]
            rank = order.get(merged)
            if rank is not None:
                heapq.heappush(agenda, (rank, i, j, merged))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            rank, i, j, merged = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != merged or after[i] != j:
                continue  # one of the two was merged meanwhile
            if self.limit and self._skipped(own, np.array([int(rank) << SYMBOL_BITS | i]))[0]:
                continue
            symbols[i], symbols[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                propose(i, k)
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s in symbols if s is not None]

    def segment_together(self, parts: list[str], draws: np.ndarray) -> list[bytes]:
        """The ids of many parts, each with the skips of its draw; a step of all agendas is a few array operations."""
        ids, counts, _, _ = self._run(*_codes(parts), draws.astype(np.uint64) if self.limit else None)
        blob, ends = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        return [blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _run(self, codes: np.ndarray, sizes: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """The ids of the parts and how many each has; without draws also the merges in their order and how many each has."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        lengths = sizes[order]
        found, first = [], 0
        while first < len(order):  # parts of about the same length at a time
            last = first + max(1, int(np.searchsorted(np.arange(1, len(order) - first + 1) * (lengths[first:] + 2), CELLS, "right")))
            if last < len(order):
                last = first + (1 << (last - first).bit_length() - 1)
            block, own = order[first:last], lengths[first:last]
            found.append(self._block(codes[_places(starts[block], own)], own, None if draws is None else draws[block]))
            first = last
        ids, counts, made, n_made = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return *_taken(ids, counts, back), *_taken(made, n_made, back)

    def _block(self, codes: np.ndarray, sizes: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """`_run` for parts in one table: a column for each, a row for each place and one row before and after them."""
        model, n, rows = self.model, len(sizes), int(sizes[-1]) + 2
        bits = (n - 1).bit_length()
        width = 1 << bits
        cells = (_places(np.ones(n, np.int64), sizes) << bits) + np.repeat(np.arange(n), sizes)
        symbols, merged = np.full(rows * width, NOTHING, np.int32), np.empty(rows * width, np.int32)
        symbols[cells] = model.characters[codes]
        value = np.full(rows * width, NONE)
        table = value.reshape(rows, width)
        after, before = np.arange(width, (rows + 1) * width), np.arange(-width, (rows - 1) * width)

        def propose(at: np.ndarray, nearest: np.ndarray) -> None:
            value[at] = NONE
            hit, found = model.pairs(symbols[at], symbols[nearest])
            at = at[hit]
            merges = model.pair_ranks[found]
            merges <<= SYMBOL_BITS
            merges += (at >> bits) - 1
            if draws is not None:
                stay = np.flatnonzero(~self._skipped(draws[at & width - 1], merges))
                at, found, merges = at[stay], found[stay], merges[stay]
            value[at] = merges
            merged[at] = model.pair_pieces[found]

        propose(cells, cells + width)
        made_column, made = [], []
        while True:
            best = table.min(axis=0)
            column = np.flatnonzero(best != NONE)
            if not len(column):
                break
            best = best[column]
            at = ((best & PLACE) + 1 << bits) + column
            gone = after[at]
            nearest = after[gone]
            symbols[at], symbols[gone], value[gone] = merged[at], NOTHING, NONE
            after[at], before[nearest] = nearest, at
            propose(np.concatenate((before[at], at)), np.concatenate((at, nearest)))
            if draws is None:
                made_column.append(column)
                made.append(best)
        ids = symbols.reshape(rows, width)[:, :n].T
        there = ids != NOTHING
        ids, counts = self._by_bytes(ids[there], there.sum(axis=1))
        if not made:
            return ids, counts, np.empty(0, np.int64), np.zeros(n, np.int64)
        made_column = np.concatenate(made_column)
        return ids, counts, np.concatenate(made)[np.argsort(made_column.astype(np.uint16), kind="stable")], np.bincount(made_column, minlength=n)

    def _by_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, where characters without a piece go by their bytes, and how many each part has."""
        size = self.model.first_character
        strange = np.flatnonzero(symbols >= size)
        if not len(strange):
            return symbols, counts
        written = [self.model.symbol_ids(chr(c - size)) for c in symbols[strange].tolist()]
        lengths = np.ones(len(symbols), np.int64)
        lengths[strange] = [len(w) for w in written]
        ids = np.repeat(symbols, lengths)
        ids[_places((np.cumsum(lengths) - lengths)[strange], lengths[strange])] = [i for w in written for i in w]
        return ids, np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))])

    def _add(self, parts: list[str]) -> range:
        """Keeps these parts."""
        codes, sizes = _codes(parts)
        ids, counts, made, n_made = self._run(codes, sizes, None)
        first = self.ids.n
        self.codes.append(codes, sizes)
        self.merges.append(made, n_made)
        self.ids.append(ids, counts)
        self.held += KEPT_BYTES * len(sizes) + 2 * (codes.nbytes + made.nbytes + ids.nbytes)  # arrays have up to twice their length
        return range(first, self.ids.n)

    def _walk(self, node: np.ndarray, draws: np.ndarray) -> None:
        """Puts -1 into `node`, the numbers of kept parts, for each occurrence that skips one of their merges."""
        made, sizes = self.merges.gather(node)
        hit = np.append(np.flatnonzero(self._skipped(np.repeat(draws, sizes), made)), len(made))
        ends = np.cumsum(sizes)
        node[hit[np.searchsorted(hit, ends - sizes)] < ends] = -1

    def _alone(self, parts: list[str], draws: np.ndarray) -> list[np.ndarray]:
        """The ids of occurrences of parts that have no tree."""
        out: list = [None] * len(parts)
        for i, p in enumerate(parts):
            if p == MARK:  # the mark itself in a text: by its bytes, so that it is not read back as a blank
                out[i] = [self.model.byte_ids[b] for b in MARK.encode()]
            elif len(p) >= LONG:
                out[i] = [k for s in self.segment(p.replace(" ", MARK), int(draws[i])) for k in self.model.symbol_ids(s)]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            for i, ids in zip(rest, self.segment_together([parts[i].replace(" ", MARK) for i in rest], draws[rest]), strict=True):
                out[i] = np.frombuffer(ids, np.int32)
        return [np.array(ids, np.int32) for ids in out]

    def _chosen(self, parts: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of occurrences, one after the other, and how many each has."""
        most = SHORT if self.limit else LONG - 1
        node = np.fromiter(map(self.roots.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(node < 0).tolist()
        fresh = list({p for i in unknown if len(p := parts[i]) <= most and p != MARK})
        if fresh:
            self.roots.update(zip(fresh, self._add(fresh), strict=True))
            node[unknown] = [self.roots.get(parts[i], -1) for i in unknown]
        kept, alone = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        whole = node[kept]
        if self.limit:
            self._walk(whole, draws[kept])
        varied, kept = kept[whole < 0], kept[whole >= 0]
        found = [(kept, *self.ids.gather(node[kept]))]
        if len(varied):
            found.append((varied, *self._run(*self.codes.gather(node[varied]), draws[varied])[:2]))
        if len(alone):
            others = self._alone([parts[i] for i in alone.tolist()], draws[alone])
            found.append((alone, np.concatenate(others), np.array([len(x) for x in others])))
        sizes = np.empty(len(parts), np.int64)
        for rows, _, counts in found:
            sizes[rows] = counts
        starts = np.cumsum(sizes) - sizes
        ids = np.empty(sizes.sum(), np.int32)
        for rows, values, counts in found:
            ids[_places(starts[rows], counts)] = values
        return ids, sizes

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Each text's ids as native 32-bit numbers; a blank is put before a text that is not empty."""
        cut = [self.model.part.findall(" " + t) if t else [] for t in texts]
        numbers = np.arange(max(map(len, cut), default=0), dtype=np.uint64)
        starts = mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) ^ self.key)
        draws = np.concatenate([mix(numbers[: len(parts)] + k) for parts, k in zip(cut, starts, strict=True)])
        parts = [p for c in cut for p in c]
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for first in range(0, len(parts), OCCURRENCES):
            if self.held > self.memory:
                self._forget()
            chosen = self._chosen(parts[first : first + OCCURRENCES], draws[first : first + OCCURRENCES])
            ids.append(chosen[0])
            sizes.append(chosen[1])
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))[np.cumsum([0, *map(len, cut)])].tolist()
        blob = np.concatenate(ids).tobytes()
        return [blob[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def dropout_encoder(path: str, dropout: float, seed: int) -> DropoutEncoder:
    """One encoder for all tasks of a worker."""
    return DropoutEncoder(piece_model(path), dropout, seed)


def _lists(blobs: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def _encoding(path: str, dropout: float, seed: int):
    def run(batches):
        encoder = dropout_encoder(path, dropout, seed)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                blobs = encoder.encode([t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(blobs)], ["id", "text", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, the text and `ids array<int>`, one row per row of docs.

    With dropout 0 the ids are those of the library; else merges are skipped by keyed hash (`DropoutEncoder`), for
    every occurrence of a word by its document and place, the same in every run. Decoding gives the text back in either case: characters without a piece, and the character that pieces use
    for a blank, go by their bytes. Null texts are empty and have no ids. Repeated rows get equal ids; null ids of rows
    count as 0 in the hash. Other columns are ignored, an empty table gives no rows. No shuffle; ids must be integers.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source = source.withColumn("key", F.coalesce("id", F.lit(0)))
    return source.mapInArrow(_encoding(model_path, dropout, seed), "id long, text string, ids array<int>").withColumnsRenamed({"id": id_col, "text": text_col})


def _decoding(path: str, place: int):
    def run(batches):
        model = piece_model(path)
        for batch in batches:
            for first in range(0, batch.num_rows, DECODED):
                part = batch.slice(first, DECODED)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.decode(part.column(place)), pa.string())], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with `decoded`, the text of `ids`; null ids give null, an empty list the empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoding(model_path, encoded.columns.index("ids")), f"{fields}, decoded string")

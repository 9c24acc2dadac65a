"""Words of many texts as arrays: bounds, 64-bit hashes and shingles without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Bytes from 0x80 on belong to
characters of more than one byte and never are white space here, so work on UTF-8 bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18  # texts are taken in chunks of about so many bytes; a longer text is a chunk of its own
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
IN_WORD = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
BYTE_VALUE = mix((_CODES.astype(np.uint64) + np.uint64(1)) * BASE)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for name, factor in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) by chunks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and at the end their number)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    inside = IN_WORD[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles of so many words as sorted 64-bit hashes.

    Fewer words: the whole sequence is one shingle. No words, empty or null: no shingle.
    """
    factors = mix(np.arange(1, 2 * width, 2, dtype=np.uint64) * BASE) | np.uint64(1)
    for _, data, offsets in text_chunks(column):
        words, bounds = word_hashes(data, offsets)
        whole = max(0, len(words) - width + 1)
        joined = np.zeros(whole, np.uint64)
        for j, f in enumerate(factors):
            joined += words[j : j + whole] * f
        joined = mix(joined)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * factors[: b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)

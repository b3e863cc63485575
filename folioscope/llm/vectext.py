"""Words, hashes and slices of Arrow text columns as numpy arrays, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
LONG_WORD = 48
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

# White space of the contracts: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a slice: byte bounds, number of the text, and first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part take at most ``limit`` bytes, or are one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the bounds of each text; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of bytes that are not white space; a run ends with its text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(bounds), np.int64))
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(start, end, text, first)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; the loop takes eight bytes of every word at a time."""
    size = end - start
    h = (size.astype(np.uint64) + np.uint64(1)) * _MIX
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    place, left, acc = start[at], size[at], h[at]
    while len(at):
        acc = (acc ^ (eight[place] & _KEEP[np.minimum(left, 8)])) * _MUL
        acc ^= acc >> np.uint64(32)
        h[at] = acc
        more = np.flatnonzero(left > 8)
        at, place, left, acc = at[more], place[more] + 8, left[more] - 8, acc[more]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return mixed(h)


def chained(h: np.ndarray, width: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words that lie in one text, and where they begin."""
    total = len(h) - width + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(total, np.uint64)
    for k in range(width):
        acc = mixed(acc * _MUL + h[k : k + total] + np.uint64(k + 1))
    inside = np.ones(total, bool)
    for cut in first[1:-1]:
        inside[max(0, cut - width + 1) : min(cut, total)] = False
    return acc[inside], np.flatnonzero(inside)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from first[i] to first[i + 1], for each i."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]

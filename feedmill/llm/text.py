"""Words of whole Arrow batches as numpy arrays, for operators that run inside Python tasks.

A batch's texts are read as the one byte buffer they already are. It is worked through in slices of about a
megabyte, so memory does not grow with the batch or with a text; only at white space is a long text cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
# Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Cache(dict):
    """Kept in a process, and left behind when a function that uses it is sent to a task."""

    def __reduce__(self):
        return _Cache, ()


_POWERS: dict[int, np.ndarray] = _Cache()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest list so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


@dataclass
class Slice:
    """Bytes of some whole rows, or of a part of one long row that ends at white space."""

    data: np.ndarray
    row_starts: np.ndarray  # place in data of each row
    rows: np.ndarray  # their numbers in the batch
    at: int  # place of data in its row, for a part of a long one; else 0


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    data, bounds = string_buffer(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        begin = bounds[row]
        end_row = max(row + 1, int(np.searchsorted(bounds, begin + size, side="right")) - 1)
        if bounds[row + 1] - begin <= size:
            yield Slice(data[begin : bounds[end_row]], bounds[row:end_row] - begin, np.arange(row, end_row), 0)
            row = end_row
            continue
        at, end = begin, bounds[row + 1]
        while at < end:
            stop = min(at + size, end)
            if stop < end:
                blank = np.flatnonzero(SPACES[data[at:stop]])
                while not len(blank) and stop < end:  # a word longer than a slice
                    ahead = np.flatnonzero(SPACES[data[stop : min(stop + size, end)]])
                    blank, stop = (ahead[:1] + (stop - at), stop) if len(ahead) else (ahead, min(stop + size, end))
                stop = at + int(blank[-1]) + 1 if len(blank) else end
            yield Slice(data[at:stop], np.zeros(1, np.int64), np.array([row]), int(at - begin))
            at = stop
        row += 1


def row_runs(column: pa.Array, size: int = 4 * SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in runs of rows with about ``size`` bytes, for work that keeps something of each text."""
    _, bounds = string_buffer(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1)
        yield column.slice(row, end - row)
        row = end


class Hashes:
    """Hash of any span of bytes, from prefix sums of byte * BASE**place modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:-1], out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), n)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def row_of_byte(part: Slice) -> np.ndarray:
    """Which of the slice's rows each byte belongs to."""
    return np.cumsum(np.bincount(part.row_starts, minlength=len(part.data) + 1), dtype=np.int32) - np.int32(1)


@dataclass
class Words:
    """Words of a slice: their bytes' places and the index of their row within the slice's rows."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def words_of(part: Slice, is_word: np.ndarray) -> Words:
    """Runs of bytes for which the 256-entry table ``is_word`` holds; a row's end ends a word."""
    inside = np.zeros(len(part.data) + 2, dtype=bool)
    inside[1:-1] = is_word[part.data]
    first = np.zeros(len(part.data) + 1, dtype=bool)
    first[part.row_starts[part.row_starts <= len(part.data)]] = True
    begins = inside[1:] & (~inside[:-1] | first)
    ends = inside[:-1] & (~inside[1:] | first)
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends), row_of_byte(part)[start])

"""Vectorised byte kernels shared by the corpus operators.

Every kernel works on the UTF-8 buffer of an Arrow string column, so one numpy
pass covers thousands of documents. A *word* is a maximal run of bytes other
than ASCII white space (tab, line feed, vertical tab, form feed, carriage
return, space); texts are never cut short.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_libc = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    size = 1 << max(10, int(n + 1).bit_length())
    if size not in _tables:
        _tables.clear()
        both = []
        for base in (_P, _PINV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[size] = (both[0], both[1])
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; unsigned 64-bit in and out."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Rows [first, first + rows) of a column: their bytes and row offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into row ranges of about max_bytes (one row at least); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(offsets)
        lengths[np.asarray(column.is_null())] = 0
        if (np.diff(offsets) != lengths).any():
            yield from slices(column.fill_null(b""), max_bytes)
            return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte range, 64-bit hash, and for each row its range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_at: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), np.diff(self.row_at))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hash of data[start:end] for each pair."""
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(s: Slice) -> Words:
    """All words of all rows of the slice."""
    blank = SPACE[s.data]
    inside = np.zeros(len(s.data) + 1, dtype=bool)
    inside[:-1] = ~blank
    begin = inside[:-1].copy()
    begin[1:] &= blank[:-1]
    heads = s.offsets[:-1][np.diff(s.offsets) > 0]
    begin[heads] = ~blank[heads]
    last = inside[:-1] & ~inside[1:]
    tails = s.offsets[1:][np.diff(s.offsets) > 0] - 1
    last[tails] = ~blank[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(start, end, range_hash(s.data, start, end), np.searchsorted(start, s.offsets))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k consecutive values; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(h))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(h) - k + 1])


def range_sum(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the values h[begin:end] for each pair."""
    power, inverse = _powers(len(h))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def give_back() -> None:
    """Returns memory that a worker's allocators keep to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def list_column(values: np.ndarray, row_at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), pa.array(values, kind))

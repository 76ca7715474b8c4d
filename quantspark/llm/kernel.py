"""Vectorised word kernel: whole Arrow text columns to word boundaries and 64-bit word hashes, without a Python loop.

A word is a maximal run of bytes other than 0x20 and 0x09..0x0D.  In UTF-8 these bytes never occur inside another
character, so byte boundaries are character boundaries.  The hash of a word is a polynomial over a table of random
64-bit values, one per byte, modulo 2**64, followed by a bijective mixer; it does not depend on the word's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa



def _return_memory() -> None:
    """Give large temporary arrays back to the system at once; workers live long, and their heaps would keep them."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


_return_memory()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE_BYTES = 2 << 20


def _table(lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[SPACE] = 0
    return values


_TABLES = {flag: _table(flag) for flag in (False, True)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _CHUNK * 4:
        return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    if "up" not in _POWERS:
        _POWERS["up"] = _powers(_BASE, _CHUNK * 4)
        _POWERS["down"] = _powers(pow(_BASE, -1, 1 << 64), _CHUNK * 4)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass(frozen=True)
class Words:
    """Words of a text column: byte ``start`` and ``end`` in ``data``; those of row i are ``ptr[i]:ptr[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, lower)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null counted as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[low:high], (offsets - low if len(offsets) else np.zeros(1, np.int64))


def words_of(column: pa.Array) -> Words:
    data, offsets = text_buffers(column)
    n = len(data)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the byte spans [start, end), which rise and do not overlap; bytes of value 0 in the table are ignored."""
    table = _TABLES[lower] if table is None else table
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + _CHUNK, "right")))
        stop = int(end[to - 1])
        up, down = _power_tables(stop - base)
        values = table[data[base:stop]] * up[: stop - base]
        local = start[at:to] - base
        out[at:to] = np.add.reduceat(values, local) * down[local]
        at = to
    return mix64(out)


def windows(hashes: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of ``n`` consecutive words of one row."""
    total = len(hashes)
    if total < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    out = np.zeros(total - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += hashes[k : total - n + 1 + k]
    rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[: total - n + 1]
    at = np.arange(total - n + 1)
    whole = at + n <= ptr[rows + 1]
    return mix64(out[whole]), rows[whole], at[whole]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row, so that temporary arrays stay small."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def pack(values: list[np.ndarray]) -> pa.Array:
    """A binary column with the bytes of each array."""
    return pa.array([v.tobytes() for v in values], pa.binary())

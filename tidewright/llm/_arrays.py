"""Vectorised text primitives on Arrow buffers.

Everything here works on whole Arrow string columns: the UTF-8 bytes of many texts
are one numpy array with row offsets, so no Python loop touches a character.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes handled at once; bounds a worker's memory (one longer text is taken alone).
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trimmed(make):
    """Wrap a function of a group, so that what it has freed goes back to the system: workers live on between tasks."""

    def run(table):
        try:
            return make(table)
        finally:
            release()

    return run


def release() -> None:
    """Give freed memory of this worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets) with at most `limit` bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(
            column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        )
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_hash(data: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Running polynomial hash; span_hash reads any span's value from it. values: a number for each byte, for another hash."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1) if values is None else values[data]) * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes[start:end] for many spans, independent of where they stand."""
    return mix(
        (
            running[end] - running[start]
        ) * _power(_INVERSE, len(running))[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93)
    )


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs never cross rows."""
    w = is_word[data]
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    starts_at = off[:-1][off[:-1] < len(w)]
    before[starts_at] = False
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:]
    ends_at = off[1:][off[1:] > 0] - 1
    after[ends_at] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row

"""Whole texts as flat UTF-8 byte arrays, with rolling hashes over any byte or word range.

Arrow string columns already are one byte buffer plus offsets, so tasks work on
numpy views of whole batches and never make a Python object per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task handles at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch with whole texts.
BATCH_ROWS = 1000

BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


def _symbol_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)


#: One random odd 64-bit number per byte value; the seed is part of the hash's definition.
CODES = _symbol_codes(7)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizes hashes so that all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, dtype=U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


_POWERS = {BASE: _Powers(BASE)}


class RollingHash:
    """Prefix sums of symbol * base**position, so that any range's hash takes two lookups."""

    def __init__(self, symbols: np.ndarray, base: int = BASE):
        n = len(symbols)
        powers = _POWERS.setdefault(base, _Powers(base))
        up, self._down = powers.upto(n + 1)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * up[:n], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), the same for equal contents anywhere."""
        return (self.prefix[end] - self.prefix[start]) * self._down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ranges of length k."""
        h = self.prefix[k:] - self.prefix[:-k]
        h *= self._down[: len(h)]
        return h


def small_batches(spark) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if more: a batch of whole texts has to fit a task twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches, between rows, into pieces of about ``limit`` bytes of text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        row, rows = 0, batch.num_rows
        while row < rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


class Words:
    """Words of every row: maximal runs of bytes that ``is_word`` marks, never across rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        low = LOWER[data]
        inside = is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[1:-1]
        edge = edge[edge < len(data)]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = edge[edge > 0] - 1
        last[before] = inside[before]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.hash = mixed(RollingHash(CODES[low]).ranges(self.start, self.end) + (self.end - self.start).astype(U64))
        #: Row r has the words bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(self.start, offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def byte_class(*ranges: tuple[int, int], negate: bool = False) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return ~table if negate else table

"""Vectorised text primitives over Arrow string columns, used inside Spark tasks.

A column is handled as one UTF-8 buffer with row offsets, so that splitting a batch of
documents into words and hashing them takes a fixed number of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; a longer document is handled alone.
CHUNK_BYTES = 1 << 18
#: ASCII whitespace: every other byte belongs to a word.
SPACES = b" \t\n\x0b\x0c\r"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


@lru_cache(maxsize=8)
def byte_class(separators: bytes) -> np.ndarray:
    """Table of 256 booleans: false for the separators."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes, cut at row offsets: starts, ends, and runs before each row."""
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        bounds = offsets[(offsets > 0) & (offsets < len(inside))]
        before[bounds] = False
        after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """64-bit finalizer, so that every bit of the result depends on every bit of the value."""
    values = values ^ (values >> _SHIFT)
    values = values * _MIX_A
    values ^= values >> _SHIFT
    values *= _MIX_B
    values ^= values >> _SHIFT
    return values


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._table(x, size) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        table = np.full(size, base, np.uint64)
        table[0] = 1
        return np.cumprod(table, dtype=np.uint64)


_BYTES, _WORDS = Powers(0x5851F42D4C957F2D), Powers(0x2545F4914F6CDD1D)


def _prefix(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers[: len(values)], out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial by prefix sums, then a finalizer."""
    up, down = _BYTES.upto(len(data) + 1)
    total = _prefix(data.astype(np.uint64) + np.uint64(1), up)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each `size` consecutive word hashes; empty if there are fewer words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(words) + 1)
    total = _prefix(words, up)
    return mix((total[size:] - total[:-size]) * down[: len(words) - size + 1])


def chunked_words(column: pa.Array, separators: bytes = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: first row, end row, bytes, word starts and ends, words before each row."""
    data, offsets = utf8(column)
    table = byte_class(separators)
    for row, end in chunks(offsets):
        part = data[offsets[row] : offsets[end]]
        starts, ends, first = runs(table[part], offsets[row : end + 1] - offsets[row])
        yield row, end, part, starts, ends, first


def fixed_list(values: np.ndarray, size: int, kind: pa.DataType) -> pa.Array:
    """List column of rows of `size` values each."""
    rows = len(values) // size
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), pa.array(values, kind))

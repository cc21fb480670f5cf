"""Vectorised word splitting and hashing of Arrow text columns, shared by several operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are handled in slices of
bounded bytes, so memory does not grow with the batch; a text longer than that is its own slice.
Hashes are 64 bits wide and depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from clusterloom.llm.common import by_value

by_value(__name__)

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[32] = True
    t[9:14] = True
    return t


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                for b in (_BASE, inverse)
            )
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes and the words in them."""

    first: int
    last: int
    data: np.ndarray  # bytes of the rows, one after the other
    offsets: np.ndarray  # last - first + 1 positions in data
    start: np.ndarray  # of each word
    end: np.ndarray
    word_offsets: np.ndarray  # last - first + 1 positions in start

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.word_offsets))


def text_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1
        last = min(n, max(last, first + 1))
        a, b = offsets[first], offsets[last]
        yield first, last, data[a:b], offsets[first:last + 1] - a
        first = last


def split(first: int, last: int, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Slice:
    """Words are maximal runs of bytes that ``gap`` (256 booleans) does not hold."""
    inside = ~gap[data]
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | begins[:n]))
    end = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return Slice(first, last, data, offsets, start, end, np.searchsorted(start, offsets, "left"))


def hash_words(s: Slice, data: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes (of ``data`` where given, else of the slice's)."""
    data = s.data if data is None else data
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[s.end] - total[s.start]) * down[s.start] + (s.end - s.start).astype(np.uint64))


def word_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[Slice, np.ndarray]]:
    """Slices of a text column, lower-cased in A-Z, and the hash of each word."""
    lower, gap = lower_table(), space_table()
    for first, last, data, offsets in text_slices(column, slice_bytes):
        s = split(first, last, lower[data], offsets, gap)
        yield s, hash_words(s)


#: Odd multipliers, one per place in a window.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` word hashes from each position on (``len(h) - width + 1`` of them)."""
    n = max(0, len(h) - width + 1)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += h[i:i + n] * _PLACES[i]
    return mix(total)


def windows_inside(word_offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions whose window of ``width`` words lies within one row."""
    n = int(word_offsets[-1])
    fits = np.ones(max(0, n - width + 1), bool)
    for back in range(1, width):
        at = word_offsets[1:] - back
        fits[at[(at >= 0) & (at < len(fits)) & (at >= word_offsets[:-1])]] = False
    return np.flatnonzero(fits)

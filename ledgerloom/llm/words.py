"""Words of UTF-8 columns as 64-bit hashes, cut and hashed with numpy on the raw bytes of an Arrow column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_classes() -> np.ndarray:
    """0 for bytes between words; else the byte, A-Z lowered: digits, letters and all of non-ASCII UTF-8."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


@lru_cache(1)
def _byte_values() -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[0] = 0
    return values


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass
class Words:
    """Word hashes of a column in order; row i has hashes[offsets[i]:offsets[i + 1]]."""

    hashes: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offset_buffer, data = filled.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def cut_words(column: pa.Array) -> Words:
    """Words are runs of digits, letters and non-ASCII characters; A-Z counts as a-z.

    Cut in pieces of 256 KB; one that ends inside a word grows to the word's end.
    """
    data, offsets = raw_bytes(column)
    classes, values = _byte_classes(), _byte_values()
    hashes, counts, at, end = [], np.zeros(len(column), np.int64), int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + _PIECE, end)
        while stop < end and classes[data[stop - 1]] and classes[data[stop]] and offsets[np.searchsorted(offsets, stop)] != stop:
            ahead = np.flatnonzero(classes[data[stop : stop + 4096]] == 0)
            row_end = int(offsets[np.searchsorted(offsets, stop, "right")])
            stop = min(stop + int(ahead[0]) if len(ahead) else stop + 4096, row_end, end)
        b = classes[data[at:stop]]
        word = b != 0
        breaks = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "left")] - at
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[breaks] = word[breaks]
        last[breaks - 1] = word[breaks - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _powers(max(_PIECE, 1 << (len(b) - 1).bit_length()))
        total = np.cumsum(values[b] * up[: len(b)], dtype=np.uint64)
        before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else total[:0]
        polynomial = (total[ends] - before) * down[starts]
        hashes.append(mix64(polynomial + (ends - starts + 1).astype(np.uint64) * np.uint64(_BASE)))
        if len(starts):
            rows = np.searchsorted(offsets, starts + at, "right") - 1
            counts[rows[0] : rows[-1] + 1] += np.bincount(rows - rows[0])
        at = stop
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def slices(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one row."""
    _, offsets = raw_bytes(column)
    out, at = [], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        out.append((at, min(end, len(column))))
        at = out[-1][1]
    return out

"""Texts of an Arrow batch as flat numpy arrays: words, their hashes, hashes of substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one slice take at most so many bytes together, unless a single text is longer.
SLICE_BYTES = 3 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of at most ``most`` bytes of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts in one array, and where each text starts (and the end).

    Null texts have no bytes.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return flat, at - at[0]


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that stays within one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(mask) + 1, bool)
    first[at] = True  # a text starts here
    starts = mask & (first[:-1] | np.r_[True, ~mask[:-1]])
    ends = mask & (first[1:] | np.r_[~mask[1:], True])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Substrings:
    """64-bit hashes of any substrings of an array, from one running sum."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        cls = Substrings
        if len(cls._power) <= n:
            size = max(1 << 16, 1 << int(n + 1).bit_length())
            back = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls._power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
            cls._inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, back)], dtype=np.uint64)
        seen = _BYTE[values] if values.dtype == np.uint8 else mixed(values + _STEP)
        seen *= cls._power[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(seen, dtype=np.uint64, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * Substrings._inverse[start]
        return mixed(h + (end - start).astype(np.uint64) * _STEP)


def word_numbers(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, the number of its first word, and the number of words at the end."""
    return np.searchsorted(starts, at)


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)

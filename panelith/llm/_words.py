"""Words of whole Arrow columns as hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Numbers are drawn beforehand for so many places of a word.
_PLACES = 48
_START = np.uint64(0x243F6A8885A308D3)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of SplitMix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def _drawn() -> np.ndarray:
    return mix((np.arange(_PLACES << 8, dtype=np.uint64) + _START) * _BASE)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; nulls are empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some rows: hashes, each word's row, its first byte and the byte after it, and each row's first word (one more at the end)."""

    def __init__(self, col: pa.Array, lower: bool):
        if lower:
            col = pc.utf8_lower(col)
        self.data, self.offsets = raw(col)
        rows = len(self.offsets) - 1
        # The separators of words: space, and tab, line feed, vertical tab, form feed and carriage return, which are 9 to 13.
        sep = (self.data == 0x20) | (self.data - np.uint8(9) < 5)
        begins, ends = ~sep, ~sep
        begins[1:] &= sep[:-1]
        ends[:-1] &= sep[1:]
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[edge] = ~sep[edge]  # a row ends a word
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        ends[last] = ~sep[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))

    @cached_property
    def hash(self) -> np.ndarray:
        """A hash of each word: the sum of numbers that are drawn for each pair of a place and a byte, so no two words are alike by their form."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        n = int(size.sum())
        place = np.arange(n) - np.repeat(first, size)
        data = self.data[np.arange(n) + np.repeat(self.start - first, size)]
        at = (place << 8) + data
        far = np.flatnonzero(place >= _PLACES)
        late = mix((at[far].astype(np.uint64) + _START) * _BASE)
        at[far] = 0
        value = _drawn()[at]
        value[far] = late
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64))

    def runs(self, n: int) -> np.ndarray:
        """The first words of all runs of n words within a row."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[n - 1 :] == self.row[: len(self.row) - n + 1])

    def joined(self, keep: np.ndarray) -> pa.Array:
        """For each row, the words for which keep holds, joined by one space."""
        at = np.flatnonzero(keep)
        row = self.row[at]
        more = np.zeros(len(at), bool)  # another word of its row follows
        more[:-1] = row[1:] == row[:-1]
        start, end = self.start[at], self.end[at] + more
        data = self.data.copy()
        data[end[more] - 1] = 0x20
        turn = np.zeros(len(data) + 1, np.int8)
        turn[start] += 1
        turn[end] -= 1
        taken = data[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate(([0], np.cumsum(end - start)))[np.searchsorted(at, self.first)]
        return pa.Array.from_buffers(pa.large_string(), len(self.first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.string())

    def combine(self, offsets: tuple[int, ...], at: np.ndarray, salt: int = 0) -> np.ndarray:
        """A hash of the words at the given offsets from each of `at`, in order."""
        h = np.full(len(at), (salt * 0xD1B54A32D192ED03 + 1) % 2**64, np.uint64)
        for o in offsets:
            h = (h + self.hash[at + o]) * _BASE
            h ^= h >> np.uint64(29)
        return mix(h)


def slices(col: pa.Array, budget: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of parts of about `budget` bytes, at least one row each."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(size)
    total = np.cumsum(size)
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + budget)))
        yield at, min(end, n) - at
        at = min(end, n)

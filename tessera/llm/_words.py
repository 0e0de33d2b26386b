"""Vectorised word hashing over Arrow string buffers: no Python string is built for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_SLICE_BYTES = 1 << 21
_POWERS = 1 << 16
#: Odd multiplier of the positional word hash (the 64-bit golden ratio).
_BASE = 0x9E3779B97F4A7C15

SPACE_BYTES = (0x20, *range(0x09, 0x0E))
NON_LETTER_BYTES = (*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
NON_ALNUM_BYTES = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(_BASE, done, 1 << 64))
        done += take
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty string."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class WordHasher:
    """64-bit hashes of the words of each text, A-Z taken as a-z before words are cut.

    A word is a maximal run of bytes outside ``separators``; all separators are ASCII, so byte runs are character runs.
    Words longer than 65,536 bytes reuse the position multipliers cyclically.
    """

    def __init__(self, separators: tuple[int, ...] = SPACE_BYTES):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.is_word[65:91] = self.is_word[97:123]
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        values[65:91] = values[97:123]
        values[~self.is_word] = 0
        self.values, self.powers = values, _powers(_POWERS)

    def spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the column, row of each word, its first byte, the byte after its last), in text order."""
        raw, off = string_buffers(column)
        if not len(raw):
            return raw, *(np.zeros(0, np.int64) for _ in range(3))
        inside = self.is_word[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1 : len(raw)]
        ends = inside
        ends[:-1] &= ~inside[1:] | edge[1 : len(raw)]
        starts = np.flatnonzero(begins)
        return raw, np.searchsorted(off, starts, "right") - 1, starts, np.flatnonzero(ends) + 1

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, hash of each word), in text order."""
        raw, rows, starts, _ = self.spans(column)
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + _SLICE_BYTES)))
            first, last = starts[at], starts[to] if to < len(starts) else len(raw)
            own = starts[at:to] - first
            within = np.arange(last - first) - np.repeat(own, np.diff(np.append(own, last - first)))
            if within.max() >= _POWERS:
                within %= _POWERS
            hashes[at:to] = np.add.reduceat(self.values[raw[first:last]] * self.powers[within], own)
            at = to
        return rows, mix64(hashes)

    def beginnings(self, column: pa.Array, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the first n bytes of each word of over n bytes, for each of ``lengths``; no word has such a hash."""
        raw, rows, starts, ends = self.spans(column)
        size, sums = ends - starts, np.zeros(len(starts), np.uint64)
        found = [(rows[:0], sums[:0])]
        for k in range(max(lengths, default=0)):
            longer = np.flatnonzero(size > k)
            sums[longer] += self.values[raw[starts[longer] + k]] * self.powers[k]
            if k + 1 in lengths:
                longer = np.flatnonzero(size > k + 1)
                found.append((rows[longer], mix64(mix64(sums[longer]) + np.uint64(k + 1))))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def hash_one(self, word: str) -> int:
        return int(self.words(pa.array([word]))[1][0])


def counts_per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)

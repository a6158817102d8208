"""Encodes texts by their units, each distinct unit once while it is remembered."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Units, and characters of units, kept per worker between slices; when full, the memory starts anew.
CACHE_UNITS, CACHE_CHARS = 300_000, 1 << 23


class UnitCache:
    """Ids of units, as encode(units) -> (ids of all units, units + 1 offsets) gives them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self._known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self._known.clear()
        self._flat, self._used = np.empty(1 << 16, np.int32), 0
        self._at, self._count, self._chars = np.zeros(CACHE_UNITS + 1, np.int64), 0, 0

    def __call__(self, rows: list[list[str]], before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with room for so many more before and after each row's, and rows + 1 offsets."""
        known = self._known
        fresh = [u for u in dict.fromkeys(chain.from_iterable(rows)) if u not in known]
        if self._count + len(fresh) > CACHE_UNITS or self._chars > CACHE_CHARS:
            self._forget()
            fresh = list(dict.fromkeys(chain.from_iterable(rows)))
        if fresh:
            self._learn(fresh)
        per_row = np.fromiter(map(len, rows), np.int64, len(rows))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(rows)), np.int64, int(per_row.sum()))
        begin = self._at[which]
        size = self._at[which + 1] - begin
        row_of = np.repeat(np.arange(len(rows)), per_row)
        tokens = np.bincount(row_of, weights=size, minlength=len(rows)).astype(np.int64)
        offsets = np.r_[0, np.cumsum(tokens + before + after)]
        out = np.zeros(int(offsets[-1]), np.int32)
        if len(which):
            to = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(to, size)
            shift = before + (before + after) * row_of
            out[np.repeat(to + shift, size) + step] = self._flat[np.repeat(begin, size) + step]
        return out, offsets

    def _learn(self, fresh: list[str]) -> None:
        flat, at = self._encode(fresh)
        need = self._used + len(flat)
        if need > len(self._flat):
            self._flat = np.concatenate([self._flat[: self._used], np.empty(need, np.int32)])
        self._flat[self._used : need] = flat
        if self._count + len(fresh) >= len(self._at):
            self._at = np.concatenate([self._at, np.zeros(len(fresh), np.int64)])
        self._at[self._count : self._count + len(fresh) + 1] = self._used + at
        self._known.update(zip(fresh, range(self._count, self._count + len(fresh)), strict=True))
        self._used, self._count = need, self._count + len(fresh)
        self._chars += sum(map(len, fresh))


class ShortKeys:
    """Numbers of short byte strings, looked up many at once: an open table of two 64-bit words a key.

    A key of up to 15 bytes is its bytes and its length, so lookups are exact.
    """

    LONGEST = 15
    _BITS = 20

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self._low, self._high = np.zeros(1 << self._BITS, np.uint64), np.zeros(1 << self._BITS, np.uint64)
        self._value = np.full(1 << self._BITS, -1, np.int32)

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of stretches of data, which needs 16 bytes to spare at its end."""
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low = words[starts] & _KEEP[np.minimum(lens, 8)]
        high = words[starts + 8] & _KEEP[np.clip(lens - 8, 0, 8)]
        return low, high | (lens.astype(np.uint64) << np.uint64(56))

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for those that aren't there."""
        slot = self._slot(low, high)
        out = self._value[slot]
        again = np.flatnonzero((out >= 0) & ((self._low[slot] != low) | (self._high[slot] != high)))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self._BITS) - 1)
            s = slot[again]
            out[again] = self._value[s]
            again = again[(out[again] >= 0) & ((self._low[s] != low[again]) | (self._high[s] != high[again]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> None:
        """Puts distinct new keys in; the table must stay well under full."""
        slot, left = self._slot(low, high), np.arange(len(low))
        while len(left):
            free = left[self._value[slot[left]] < 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            s = slot[first]
            self._low[s], self._high[s], self._value[s] = low[first], high[first], values[first]
            placed = np.zeros(len(low), bool)
            placed[first] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & ((1 << self._BITS) - 1)


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

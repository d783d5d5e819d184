"""Bounded caches from repeated text units (words with their spacing) to ids."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np

#: A worker forgets all units once it holds so many bytes: a unit counts with its
#: characters and ids and ``UNIT_BYTES`` for its places in the tables.
CACHE_BYTES, UNIT_BYTES = 150_000_000, 150


class UnitCache:
    """``encode(units) -> (ids end to end, ids per unit)`` is asked for unseen units only.
    No more is held than ``limit`` bytes and the units of one call."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = self.held = 0
        self.start = np.empty(1 << 16, np.int64)
        self.count = np.empty(1 << 16, np.int32)

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.empty(max(need, 2 * len(a)) - len(a), a.dtype)])

    def codes(self, units: list[str]) -> np.ndarray:
        """A code for each unit; valid until the next call."""
        if self.held > self.limit:
            self._reset()
        out = np.fromiter(map(self.code.get, units, repeat(-1)), np.int64, len(units))
        unseen = np.flatnonzero(out < 0)
        if len(unseen):
            asked = [units[i] for i in unseen.tolist()]
            new = list(dict.fromkeys(asked))
            ids, counts = self.encode(new)
            n = len(self.code)
            self.ids = self._room(self.ids, self.used + len(ids))
            self.start, self.count = self._room(self.start, n + len(new)), self._room(self.count, n + len(new))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[n : n + len(new)] = self.used + np.cumsum(counts) - counts
            self.count[n : n + len(new)] = counts
            self.used += len(ids)
            self.held += UNIT_BYTES * len(new) + sum(map(sys.getsizeof, new)) + ids.nbytes
            self.code.update(zip(new, range(n, n + len(new)), strict=True))
            out[unseen] = np.arange(n, n + len(new)) if len(new) == len(asked) else np.fromiter(map(self.code.__getitem__, asked), np.int64, len(asked))
        return out

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, running end of each unit)."""
        n = self.count[codes]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[codes] - (ends - n), n) + np.arange(total)], ends


def groups(texts: list[str], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def filled(column: Iterable) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]

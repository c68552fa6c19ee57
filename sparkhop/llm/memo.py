"""What a worker remembers of word parts, for the two tokenizers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import words

#: Word parts whose ids a worker remembers at most, about 40 bytes each.
MEMO = 3_000_000


def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of a pool one after the other, where each begins and the end)."""
    run = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=run[1:])
    return pool[np.repeat(begin - run[:-1], size) + np.arange(run[-1])], run


class Memo:
    """Ids by 64-bit hash of a word part: sorted hashes, and where in a pool of
    ids each part's begin.  Late parts are held apart until they are many.  With
    ``MEMO`` parts at most, two that differ share a hash with probability 2e-13
    for each part that is looked up."""

    def __init__(self) -> None:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.old, self.new = empty, empty
        self.bounds, self.pool = np.zeros(1, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def _find(held: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        keys, numbers = held
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, numbers[at], -1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each part, -1 where it is unknown."""
        return np.maximum(self._find(self.old, h), self._find(self.new, h))

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = (np.concatenate(x) for x in zip(a, b))
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        first = len(self.bounds) - 1
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids])])
        self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], "<u4")])
        self.new = self._merged(self.new, (h, first + np.arange(len(h))))
        if 8 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = self._merged(self.old, self.new), (h[:0], np.zeros(0, np.int64))

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, ids_of: Callable[[list[bytes]], list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of byte spans one after the other, where each span's begin and
        the end).  ``ids_of`` gives those of parts that are not remembered."""
        h, first, of = np.unique(words.span_hashes(data, start, end), return_index=True, return_inverse=True)
        number = self.find(h)
        unknown = np.flatnonzero(number < 0)
        if len(self.bounds) > 1 and len(self.bounds) + len(unknown) > MEMO:
            self.__init__()
            unknown = np.arange(len(h))
        if len(unknown):
            ids = ids_of([data[a:b].tobytes() for a, b in zip(start[first[unknown]].tolist(), end[first[unknown]].tolist())])
            number[unknown] = len(self.bounds) - 1 + np.arange(len(unknown))
            self.add(h[unknown], ids)
        begin, size = self.bounds[number], self.bounds[number + 1] - self.bounds[number]
        return gathered(self.pool, begin[of], size[of])

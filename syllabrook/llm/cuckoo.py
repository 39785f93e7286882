"""Cuckoo filters over 128-bit digests: insertion, deletion and look-up by whole arrays.

A digest has a fingerprint of 16 bits (never 0) and two buckets of ``SLOTS`` cells; each bucket follows from the other
and the fingerprint, so a fingerprint can be moved without its digest. Whoever finds both buckets full moves another
fingerprint on; after ``KICKS`` moves the last one is put on a list beside the table, which is looked through as well,
so insertion never fails. A digest that was inserted is always found until it is deleted; others are found by chance,
about once in 8,000.
"""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
#: Share of the cells that may be taken before a larger filter is due.
FULL = 0.8


def _marks(digests: np.ndarray) -> np.ndarray:
    """Fingerprints of digests, which are rows of two numbers of 64 bits."""
    return np.maximum(digests[:, 0] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)


class Cuckoo:
    def __init__(self, buckets: int, cells: np.ndarray | None = None, spare: np.ndarray | None = None, n: int = 0) -> None:
        self.cells = np.zeros((buckets, SLOTS), dtype=np.uint16) if cells is None else cells
        self.spare = [] if spare is None else [tuple(map(int, x)) for x in spare]
        self.n = n

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint that lies in ``bucket``."""
        h = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        return bucket ^ (h.astype(np.int64) & (len(self.cells) - 1))

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = _marks(digests)
        first = (digests[:, 1] & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def has(self, digests: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(digests)
        found = (self.cells[a] == mark[:, None]).any(axis=1) | (self.cells[b] == mark[:, None]).any(axis=1)
        for m, at in self.spare:
            found |= (mark == m) & ((a == at) | (b == at))
        return found

    def insert(self, digests: np.ndarray) -> None:
        """Adds each digest once more; no digest may be inserted that is there already and will be deleted once only."""
        mark, a, b = self.places(digests)
        self.n += len(mark)
        left = np.arange(len(mark))
        for bucket in (a, b):
            left = self._settle(mark, bucket, left)
        for i in left.tolist():
            self._kick(int(mark[i]), int(b[i]))

    def _settle(self, mark: np.ndarray, bucket: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free cells of their bucket; returns those that found none."""
        which = which[np.argsort(bucket[which], kind="stable")]
        at = bucket[which]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        free = self.cells[at] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free[fits], axis=1) == (rank[fits] + 1)[:, None], axis=1)
        self.cells[at[fits], slot] = mark[which[fits]]
        return which[~fits]

    def _kick(self, mark: int, bucket: int) -> None:
        for k in range(KICKS):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return
            slot = (bucket + k) % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = int(self.other(np.array([bucket]), np.array([mark], dtype=np.uint16))[0])
        self.spare.append((mark, bucket))

    def delete(self, digests: np.ndarray) -> None:
        """Takes one fingerprint of each digest away; all of them must have been inserted."""
        for m, a, b in zip(*(x.tolist() for x in self.places(digests)), strict=True):
            for at in (a, b):
                slot = np.flatnonzero(self.cells[at] == m)
                if len(slot):
                    self.cells[at, slot[0]] = 0
                    break
            else:
                self.spare.remove(next(x for x in self.spare if x[0] == m and x[1] in (a, b)))
            self.n -= 1

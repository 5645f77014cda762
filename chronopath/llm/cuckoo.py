"""Cuckoo filters over arrays of 128-bit keys: many keys are put in, taken out and looked up at a time."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 300
_LOAD = 0.8


def buckets_for(n: int) -> int:
    """A power of two of buckets that hold n keys at a load that lets them in."""
    return 1 << max(1, int(np.ceil(np.log2(max(n, 1) / (SLOTS * _LOAD)))))


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a fingerprint lies in one of two buckets, each found from the other."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.int64(len(table) - 1)

    @classmethod
    def empty(cls, n: int) -> Cuckoo:
        return cls(np.zeros((buckets_for(n), SLOTS), np.uint16))

    @classmethod
    def of(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = (keys[:, 1] & 0xFFFF).astype(np.uint16)
        return np.where(fp == 0, np.uint16(1), fp), keys[:, 0] & self.mask

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def has(self, keys: np.ndarray) -> np.ndarray:
        fp, b = self._place(keys)
        return (self.table[b] == fp[:, None]).any(1) | (self.table[self._other(fp, b)] == fp[:, None]).any(1)

    def __len__(self) -> int:
        return int((self.table > 0).sum())

    def insert(self, keys: np.ndarray) -> bool:
        """Put distinct keys in; False, and nothing changed, if they don't all find a place."""
        before, rng = self.table.copy(), np.random.default_rng(len(keys))
        fp, b = self._place(keys)
        for _ in range(KICKS):
            for _side in range(2):
                if not len(fp):
                    return True
                o = np.argsort(b, kind="stable")
                fp, b = fp[o], b[o]
                rank = np.arange(len(b)) - np.searchsorted(b, b)
                free = self.table[b] == 0
                fit = rank < free.sum(1)
                slot = np.argsort(~free[fit], axis=1, kind="stable")[np.arange(fit.sum()), rank[fit]]
                self.table[b[fit], slot] = fp[fit]
                fp, b = fp[~fit], b[~fit]
                b = self._other(fp, b)
            if not len(fp):
                return True
            # One of those that found both buckets full takes a place in each bucket; who lay there moves on.
            u, first = np.unique(b, return_index=True)
            slot = rng.integers(0, SLOTS, len(u))
            out = self.table[u, slot].copy()
            self.table[u, slot] = fp[first]
            rest = np.setdiff1d(np.arange(len(b)), first)
            fp, b = np.r_[out, fp[rest]], np.r_[self._other(out, u), b[rest]]
        self.table[:] = before
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Take keys out that were put in; which of them were found."""
        fp, b = self._place(keys)
        found, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for side in (0, 1):
            at = b if side == 0 else self._other(fp, b)
            todo = left
            while len(todo):
                hit = self.table[at[todo]] == fp[todo][:, None]
                todo, hit = todo[hit.any(1)], hit[hit.any(1)]
                # Of several keys that mean the same slot the first takes it, the others look again.
                place, first = np.unique(at[todo] * SLOTS + hit.argmax(1), return_index=True)
                self.table[place // SLOTS, place % SLOTS] = 0
                found[todo[first]] = True
                todo = np.setdiff1d(todo, todo[first])
            left = np.flatnonzero(~found)
        return found

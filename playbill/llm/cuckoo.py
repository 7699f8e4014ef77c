"""A cuckoo filter over 64-bit keys in numpy: insertion, deletion and membership of whole arrays.

A bucket holds four 16-bit fingerprints; a key may sit in two buckets, and each
follows from the other and the fingerprint alone, so keys can be moved and
deleted without being stored. There are no false negatives; a miss of the exact
table behind it is a false positive (about 8 / 65,536).
"""

from __future__ import annotations

import numpy as np

from playbill.llm.words import U64, mix

SLOTS, LOAD, KICKS = 4, 0.85, 500


def sketch(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first bucket, second bucket); a fingerprint is never 0."""
    h = mix(keys.astype(U64))
    prints = ((h >> U64(40)) % U64(65535) + U64(1)).astype(np.uint16)
    first = (h & U64(buckets - 1)).astype(np.int64)
    return prints, first, other(prints, first, buckets)


def other(prints: np.ndarray, bucket: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ (mix(prints.astype(U64)) & U64(buckets - 1)).astype(np.int64)


class CuckooFilter:
    def __init__(self, capacity: int = 0, table: np.ndarray | None = None) -> None:
        if table is None:
            need = max(1, int(np.ceil(capacity / (SLOTS * LOAD))))
            table = np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16)
        self.table = table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys; a table that turns out too full is doubled."""
        capacity = len(keys)
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity = max(8, 2 * SLOTS * len(made.table))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all fitted; if not, the filter must be rebuilt larger from the exact table."""
        prints, first, second = sketch(keys, len(self.table))
        rng = np.random.default_rng(7)
        for p, a, b in zip(prints, first, second, strict=True):
            if not (self._put(p, a) or self._put(p, b) or self._kick(p, b, rng)):
                return False
        return True

    def _put(self, p: np.uint16, bucket: int) -> bool:
        row = self.table[bucket]
        for slot in range(SLOTS):
            if row[slot] == 0:
                row[slot] = p
                return True
        return False

    def _kick(self, p: np.uint16, bucket: int, rng: np.random.Generator) -> bool:
        for _ in range(KICKS):
            slot = int(rng.integers(SLOTS))
            p, self.table[bucket, slot] = self.table[bucket, slot], p
            bucket = int(other(np.array([p]), np.array([bucket]), len(self.table))[0])
            if self._put(p, bucket):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Forget keys that were inserted before; another key never loses its fingerprint by it."""
        prints, first, second = sketch(keys, len(self.table))
        for p, a, b in zip(prints, first, second, strict=True):
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == p)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = sketch(keys, len(self.table))
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

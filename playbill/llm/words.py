"""Words and shingles of whole Arrow columns, hashed in numpy without a Python step per word.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``. A column is cut into
chunks of whole documents, so memory follows the chunk or the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
SPACES = b" \t\n\x0b\x0c\r"


def table(lower: bool = False, blank: bytes = b"") -> np.ndarray:
    """What each byte becomes: white space and ``blank`` a space, A-Z small letters if asked for."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(SPACES + blank)] = 32
    return out


PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Small letters A-Z; CLEAN also takes ASCII punctuation as white space.
LOWER, CLEAN = table(lower=True), table(lower=True, blank=PUNCTUATION)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    return mix(U64(seed * 0x9E3779B97F4A7C15 & 2**64 - 1) + np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95))


BYTES = constants(256, 1)
STEPS = constants(64, 2) | U64(1)
BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n, modulo 2**64."""
    out = np.full(n + 1, U64(base & (2**64 - 1)))
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next chunk."""
    if n > CHUNK + 64:
        return _power(BASE, n), _power(pow(BASE, -1, 2**64), n)
    if not _powers:
        _powers["up"], _powers["down"] = _power(BASE, CHUNK + 64), _power(pow(BASE, -1, 2**64), CHUNK + 64)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): ``(sums[e] - sums[s]) * inverse[s]`` identifies the bytes s to e."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words of a chunk: starts and ends in bytes, document of each, hash of each, first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray) -> None:
        n = len(data)
        self.data = mapping[data]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = self.data != 32
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = inside[1:-1][edges]
        ends[edges - 1] = inside[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        sums, down = prefix_sums(self.data)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64) * STEPS[63])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (of all words: windows may cross documents)."""
        h, n = self.hashes, len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = h[:n] * STEPS[0]
        for j in range(1, k):
            out += h[j : j + n] * STEPS[j]
        return mix(out)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets by document) of k-word shingles; a text of fewer words is one, an empty text none."""
        count = np.where(self.counts >= k, self.counts - k + 1, (self.counts > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(count)])
        whole = self.counts >= k
        out = np.zeros(at[-1], U64)
        windows = self.windows(k)
        own = np.repeat(whole, count)
        position = np.repeat(self.first[:-1] - at[:-1], count) + np.arange(at[-1])
        out[own] = windows[position[own]]
        for d in np.flatnonzero(~whole & (self.counts > 0)):
            h = self.hashes[self.first[d] : self.first[d + 1]]
            out[at[d]] = mix((h * STEPS[: len(h)]).sum(dtype=U64, keepdims=True) + U64(len(h)))[0]
        return out, at


def shingle_sets(column: pa.Array, k: int = 5, mapping: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in chunks(column):
        hashes, at = Words(data, offsets, mapping).shingles(k)
        for i in range(len(at) - 1):
            yield np.unique(hashes[at[i] : at[i + 1]])

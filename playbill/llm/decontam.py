"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may differ by k = floor(rate * m) word edits. Cut into k + 1
pieces, at least one piece must occur unchanged in any text that holds the item with
at most k edits. Exact piece hits are found by hashes of word runs; around each hit
Myers' bit-parallel algorithm computes the distance of the item to the best-fitting
passage, one text word per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.storage import clean_columns
from playbill.llm.words import CLEAN, U64, Words, chunks

RATE, EXACT_WORDS, BLOCK_BYTES = 0.15, 8, 16 << 20


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed for m words; items of fewer than EXACT_WORDS words must match exactly."""
    return int(m * rate) if m >= EXACT_WORDS else 0


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 pieces as equal as possible."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def item_words(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, offsets in chunks(texts):
        w = Words(data, offsets, CLEAN)
        out += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, as ``Words.windows`` gives it."""
    w = Words.__new__(Words)
    w.hashes = words
    return w.windows(k)


class Matcher:
    """Pieces of a block of items, by length, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], rate: float = RATE) -> None:
        self.ids, self.words = ids, item_words(pa.array(texts, pa.string()))
        self.edits = [budget(len(w), rate) for w in self.words]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            for start, length in pieces(len(w), self.edits[i]) if len(w) else ():
                found.setdefault(length, []).append((int(run_hashes(w[start : start + length], length)[0]), i, start))
        self.tables = {}
        for length, rows in found.items():
            rows.sort()
            self.tables[length] = (np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.masks: dict[int, dict[int, int]] = {}

    def mask(self, i: int) -> dict[int, int]:
        """For each word of the item, the bits of its places."""
        if i not in self.masks:
            out: dict[int, int] = {}
            for at, w in enumerate(self.words[i].tolist()):
                out[w] = out.get(w, 0) | 1 << at
            self.masks[i] = out
        return self.masks[i]

    def hits(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(document, item, word where the item would begin) of every exact piece hit of a chunk, sorted."""
        doc = np.repeat(np.arange(len(w.counts)), w.counts)
        out = []
        for length, (hashes, item, start) in self.tables.items():
            windows = w.windows(length)
            if not len(windows):
                continue
            inside = doc[: len(windows)] == doc[length - 1 :]
            lo = np.searchsorted(hashes, windows, "left")
            at = np.flatnonzero(inside & (hashes[np.minimum(lo, len(hashes) - 1)] == windows))
            for p, first in zip(at.tolist(), lo[at].tolist(), strict=True):
                while first < len(hashes) and hashes[first] == windows[p]:
                    out.append((int(doc[p]), int(item[first]), p - int(start[first])))
                    first += 1
        return iter(sorted(set(out)))

    def matches(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, distance, end word in the document) of the best passage of each pair within the budget."""
        pending: tuple[int, int] | None = None
        spans: list[list[int]] = []
        for d, i, begin in [*self.hits(w), (-1, -1, 0)]:
            if (d, i) != pending:
                if pending is not None and (best := self.verify(w, *pending, spans)) is not None:
                    yield (*pending, *best)
                pending, spans = (d, i), []
            if d >= 0:
                lo = max(int(w.first[d]), begin - self.edits[i])
                hi = min(int(w.first[d + 1]), begin + len(self.words[i]) + self.edits[i])
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])

    def verify(self, w: Words, d: int, i: int, spans: list[list[int]]) -> tuple[int, int] | None:
        m, best = len(self.words[i]), None
        for lo, hi in spans:
            distance, end = myers(self.mask(i), m, w.hashes[lo:hi].tolist())
            if distance <= self.edits[i] and (best is None or distance < best[0]):
                best = (distance, lo + end - int(w.first[d]))
        return best


def myers(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to any run of the text, where the first such run ends)."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += (up & top != 0) - (down & top != 0)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in parts that each fit into a task, by a hash of their id."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with ``item_ids`` they hold, sorted, and ``distances``, the word edits of each.

    ``items`` has item_id and text. Case of A-Z, ASCII punctuation and white space do not count. Items of
    fewer than 8 words must occur unchanged; items without a word, or null, match nothing, and neither
    does a null or empty text. Repeated items, or items with a null id, count like others. Documents are
    read in place, whole, and nothing is shuffled; items travel to the tasks in blocks of at most about
    ``block_bytes``, one pass for each. Input columns of the added names are dropped. Empty tables give
    empty results or empty lists.
    """
    added = ["item_ids", "distances"]
    out = docs.select(*clean_columns(docs, added)).withColumns({c: F.array().cast(f"array<{t}>") for c, t in zip(added, ("bigint", "int"), strict=True)})
    for block in _blocks(items.select("item_id", "text"), block_bytes):
        rows = sorted(block.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        sent = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        out = out.mapInArrow(_marker(sent, rate), out.schema)
    return out


def _marker(sent, rate: float):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*sent.value, rate)
        for batch in batches:
            ids, distances = batch.column("item_ids").to_pylist(), batch.column("distances").to_pylist()
            for first, data, offsets in chunks(batch.column("text")):
                for d, i, distance, _ in matcher.matches(Words(data, offsets, CLEAN)):
                    ids[first + d].append(matcher.ids[i])
                    distances[first + d].append(distance)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"item_ids": pa.array(ids, pa.list_(pa.int64())), "distances": pa.array(distances, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], names=batch.schema.names)

    return mark


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    names = docs.columns
    inside = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index('text')}"))
    return find_items(inside, items, rate).where(F.size("item_ids") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

"""Alignment of two tokenizers over a corpus, by products of sparse incidence matrices.

A token is a row of a matrix with a column for each byte it covers. The product of tokenizer A's matrix with the
transpose of B's holds the *overlap links*: pairs of tokens with common bytes. Tokens that
overlap links chain together are a *group*; its ends are the places where tokens of both end. The product of the tokens' group incidences holds
the *shared-group links*. Matrices are compressed rows in numpy; products are taken row by row (Gustavson), a block of rows at a time.

Both tokenizers work word by word: neither has an entry that continues beyond a single space between two visible characters. So a task cuts
its texts there, aligns each distinct segment once, and sums up documents from their segments. Whether a vocabulary
allows that is checked when it is loaded; otherwise a segment is a whole text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.storage import Workspace
from playbill.llm.words import STEPS, U64, chunks, mix, prefix_sums

TOKENIZERS = "/opt/tokenizers"
#: A task takes texts of so many bytes together, or one longer text.
BLOCK = 1 << 20
#: So many distinct segments, the first a task meets, are kept for its later blocks.
STORE = 1 << 17
#: Rows of a product are expanded so many entries at a time.
EXPAND = 1 << 20
#: At most so many pairs are broadcast; pairs that fewer documents hold meet their links by a shuffle.
HEAVY = 1 << 18

# Fixed value: how byte-level BPE vocabularies of this kind divide a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class CSR:
    """A sparse matrix of compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> None:
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> CSR:
        """From entries in any order."""
        order = np.argsort(rows, kind="stable")
        return cls(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=height))]), columns[order], values[order], width)

    @classmethod
    def spans(cls, lengths: np.ndarray) -> CSR:
        """Row i covers the ``lengths[i]`` columns after those of row i - 1."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transpose(self) -> CSR:
        return CSR.of(self.columns, self.rows(), self.values, self.width, len(self.starts) - 1)

    def product(self, other: CSR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (rows, columns, values) of the product, rows in order, in blocks of whole rows.

        Row i is the sum of ``other``'s rows that row i's columns name. A block is expanded, then equal places are added.
        """
        work = np.diff(other.starts)[self.columns]
        upto = np.concatenate([[0], np.cumsum(work)])[self.starts]
        first, last, n = 0, 0, len(self.starts) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + EXPAND, "right")) - 1)
            a, b = self.starts[first], self.starts[last]
            size = work[a:b]
            entry = np.repeat(np.arange(a, b), size)
            within = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size)
            at = other.starts[self.columns[entry]] + within
            row = np.repeat(np.arange(first, last), np.diff(self.starts[first : last + 1]))[entry - a]
            place, value = add_up(row * other.width + other.columns[at], self.values[entry] * other.values[at])
            yield place // other.width, place % other.width, value
            first = last


def add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's positive values."""
    if not len(keys):
        return keys, values
    if (np.diff(keys) < 0).any():
        bits = int(values.max()).bit_length()
        if int(keys.max()).bit_length() + bits < 63:  # sorting one number is several times faster than sorting places
            both = np.sort(keys << bits | values)
            keys, values = both >> bits, both & (1 << bits) - 1
        else:
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[first], np.add.reduceat(values, first)


class ByteLevel:
    """Byte-level BPE from the JSON form of its vocabulary; a token is the bytes its entry's letters stand for."""

    def __init__(self, data: bytes) -> None:
        import tiktoken

        # Bytes that stand for themselves; the others follow from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        model = json.loads(data)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["model"]["vocab"].items() if entry not in special}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64)
        self.divides = True  # by PATTERN
        self._encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentencepiece model; it puts the space before a text itself."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.fromiter(map(len, self.tokens), np.int64)
        self.divides = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two visible characters.

    Characters that could be white space beyond ASCII do not count as visible, nor do those of four bytes: a segment may be longer than it need be.
    """
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[at - 1], data[at + 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    high = before >= 128
    ends = (before > 32) & (before < 127) | high & ((two >= 0xC3) & (two <= 0xDF) | (two >= 128) & (two < 0xC0) & (three >= 0xE4) & (three <= 0xEF))
    begins = (after > 32) & (after < 127) | (after >= 0xC3) & (after <= 0xDF) | (after >= 0xE4) & (after <= 0xEF)
    return at[ends & begins]


class Segments:
    """Distinct segments of a block of texts, aligned: token, group and link counts, link pairs and group strings of each."""

    def __init__(self, texts: list[bytes], a: ByteLevel, b: Pieces) -> None:
        codes = [x.encode([t[1:].decode() for t in texts]) for x in (a, b)]
        n, sizes = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        alive = np.ones(n, bool)
        if not all(same(x, c, texts, sizes) for x, c in zip((a, b), codes, strict=True)):
            alive[:] = [all(b"".join(map(x.tokens.__getitem__, c)) == t for x, c in zip((a, b), pair, strict=True)) for t, *pair in zip(texts, *codes, strict=True)]
        ids, owners, lengths = [], [], []
        for x, lists in zip((a, b), codes, strict=True):
            flat, owner = flatten([c if ok else () for c, ok in zip(lists, alive, strict=True)])
            ids.append(flat)
            owners.append(owner)
            lengths.append(x.lengths[flat])
        self.alive = alive
        group_a, group_b, self.n_overlaps = groups(*lengths, owners[0], n)
        self.n_a, self.n_b = (np.bincount(o, minlength=n) for o in owners)
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        owner_of_group = np.zeros(n_groups, np.int64)
        owner_of_group[group_a] = owners[0]
        self.n_groups = np.bincount(owner_of_group, minlength=n)
        self.pairs, self.times, self.starts = links(ids, owners, (group_a, group_b), n_groups, n)
        self.n_links = np.add.reduceat(np.append(self.times, 0), self.starts[:-1]) * (np.diff(self.starts) > 0) if n else np.zeros(0, np.int64)
        self.strings = strings(ids, (group_a, group_b), owner_of_group, n_groups, n)

    def joined(self, other: Segments) -> Segments:
        """These segments, then the others."""
        out = Segments.__new__(Segments)
        for name in ("alive", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "pairs", "times"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        out.starts = np.concatenate([self.starts, self.starts[-1] + other.starts[1:]])
        out.strings = self.strings + other.strings
        return out


class Store:
    """Segments a task has aligned already, by hash. Once it is full, new ones serve their own block only."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.segments = Segments([], a, b)
        self.hashes, self.places = np.zeros(0, U64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, text: Callable[[int], bytes]) -> tuple[Segments, np.ndarray]:
        """(segments, place of each of the distinct ``hashes`` among them); ``text`` gives the bytes of one of them."""
        near = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new, n = np.flatnonzero(~hit), len(self.segments.strings)
        places = np.empty(len(hashes), np.int64)
        places[hit] = self.places[near[hit]]
        places[new] = n + np.arange(len(new))
        both = self.segments.joined(Segments([text(i) for i in new.tolist()], self.a, self.b)) if len(new) else self.segments
        if n + len(new) <= STORE:
            at = np.searchsorted(self.hashes, hashes[new])
            self.segments, self.hashes, self.places = both, np.insert(self.hashes, at, hashes[new]), np.insert(self.places, at, places[new])
        return both, places


def flatten(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the list of each)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum()), np.repeat(np.arange(len(lists)), sizes)


def same(x: ByteLevel | Pieces, codes: list[list[int]], texts: list[bytes], sizes: np.ndarray) -> bool:
    """Whether the codes give all texts back: together, and each as long as it was."""
    flat, owner = flatten(codes)
    return bool((np.bincount(owner, x.lengths[flat], len(texts)) == sizes).all()) and b"".join(map(x.tokens.__getitem__, flat.tolist())) == b"".join(texts)


def groups(a_lengths: np.ndarray, b_lengths: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, of each B token, overlap links of each segment) from the overlap product."""
    group_a, group_b = np.zeros(len(a_lengths), np.int64), np.zeros(len(b_lengths), np.int64)
    overlaps, last, count = np.zeros(n, np.int64), -1, -1
    for rows, columns, _ in CSR.spans(a_lengths).product(CSR.spans(b_lengths).transpose()):
        first = np.flatnonzero(np.concatenate([[True], np.diff(rows) != 0]))
        lowest, highest = columns[first], columns[np.append(first[1:], len(rows)) - 1]
        # A token goes on with the group before if it overlaps that group's last B token.
        fresh = lowest != np.concatenate([[last], highest[:-1]])
        number = count + np.cumsum(fresh)
        group_a[rows[first]] = number
        group_b[columns] = np.repeat(number, np.diff(np.append(first, len(rows))))
        overlaps += np.bincount(owner[rows], minlength=n)
        last, count = highest[-1], number[-1]
    return group_a, group_b, overlaps


def links(ids: list[np.ndarray], owners: list[np.ndarray], group: tuple[np.ndarray, np.ndarray], n_groups: int, n: int) -> tuple[np.ndarray, ...]:
    """(links as a << 32 | b, how often each occurs, first link of each segment).

    Rows of a group incidence are the ids of a segment; a value tells how often the id stands in the group. So
    the product counts occurrences of pairs, and an id that fills a long group is one entry.
    """
    matrices, names = [], []
    for i in (0, 1):
        rows, row = np.unique(owners[i] << 20 | ids[i], return_inverse=True)
        place, times = add_up(row * max(n_groups, 1) + group[i], np.ones(len(row), np.int64))
        matrices.append(CSR.of(place // max(n_groups, 1), place % max(n_groups, 1), times, len(rows), n_groups))
        names.append(rows)
    found = [(names[0][r], names[1][c] & (1 << 20) - 1, v) for r, c, v in matrices[0].product(matrices[1].transpose())]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    left, right, times = (np.concatenate(x) for x in zip(*found, strict=True))
    return (left & (1 << 20) - 1) << 32 | right, times, np.searchsorted(left >> 20, np.arange(n + 1))


def strings(ids: list[np.ndarray], group: tuple[np.ndarray, np.ndarray], owner: np.ndarray, n_groups: int, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each segment."""
    parts = []
    for i in (0, 1):
        names, at = list(map(str, ids[i].tolist())), np.searchsorted(group[i], np.arange(n_groups + 1)).tolist()
        parts.append([names[x] if y == x + 1 else ",".join(names[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)])
    whole = [f"{x}|{y}" for x, y in zip(*parts, strict=True)]
    at = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return [whole[x] if y == x + 1 else ";".join(whole[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


ALIGNED = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, n_links bigint, groups string, groups_sha256 string, "
           "links array<struct<a: int, b: int, n: int>>")
_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


def blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most BLOCK bytes together, or one longer text."""
    sizes = np.nan_to_num(np.array(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), float)).astype(np.int64)
    upto, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + BLOCK, "right")) - 1)
        yield first, last
        first = last


def align_block(ids: list, column: pa.Array, store: Store, row: int, with_groups: bool) -> pa.RecordBatch:
    """One row of ALIGNED for each text."""
    hashes, owner, texts = [], [], []
    for first, data, offsets in chunks(column):
        n_docs = len(offsets) - 1
        # Each text gets the space in front that belongs to it; an empty one has no segment.
        sizes = np.diff(offsets)
        own = np.repeat(np.arange(n_docs), sizes)
        spaced = np.full(len(data) + n_docs, 32, np.uint8)
        spaced[np.arange(len(data)) + own + 1] = data
        begin = offsets[:-1] + np.arange(n_docs)
        starts_here = np.zeros(len(spaced), bool)
        starts_here[begin] = True
        if store.a.divides and store.b.divides and len(spaced) > 2:
            starts_here[cuts(spaced)] = True
        starts = np.flatnonzero(starts_here)
        ends = np.append(starts[1:], len(spaced))
        which = np.searchsorted(begin, starts, "right") - 1
        full = sizes[which] > 0
        starts, ends, which = starts[full], ends[full], which[full]
        sums, down = prefix_sums(spaced)
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * STEPS[63]))
        owner.append(which + first)
        texts.append((spaced.tobytes(), starts, ends))
    n = len(ids)
    hashed, doc = np.concatenate(hashes), np.concatenate(owner)
    base = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in texts])])
    order = np.argsort(hashed, kind="stable")
    new = np.concatenate([[True], np.diff(hashed[order]) != 0]) if len(order) else np.zeros(0, bool)
    segment = np.empty(len(hashed), np.int64)
    segment[order] = np.cumsum(new) - 1
    samples = order[new]
    part = np.searchsorted(base, samples, "right") - 1

    def text(k: int) -> bytes:
        i = int(samples[k])
        data, s, e = texts[part[k]]
        return data[s[i - base[part[k]]] : e[i - base[part[k]]]]

    known, places = store.find(hashed[samples], text)
    segment = places[segment]
    # A document with a segment that either tokenizer does not give back has no tokens.
    alive = np.bincount(doc, ~known.alive[segment], n) == 0
    own = alive[doc]
    doc, segment = doc[own], segment[own]
    total = lambda x: np.bincount(doc, x[segment], n).astype(np.int64)
    at = np.searchsorted(doc, np.arange(n + 1))
    # Links: distinct segments of each document first, then the distinct pairs of those.
    m = max(len(known.strings), 1)
    place, times = add_up(np.sort(doc * m + segment), np.ones(len(doc), np.int64))
    seg = place % m
    sizes = np.diff(known.starts)[seg]
    entry = np.repeat(np.arange(len(seg)), sizes)
    link = known.starts[seg][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pairs, pair_of = np.unique(known.pairs, return_inverse=True)
    p = max(len(pairs), 1)
    place, times = add_up((place // m)[entry] * p + pair_of[link], times[entry] * known.times[link])
    pair = pairs[place % p] if len(place) else np.zeros(0, np.int64)
    struct = pa.StructArray.from_arrays([pa.array(pair >> 32, pa.int32()), pa.array(pair & 0xFFFFFFFF, pa.int32()), pa.array(times, pa.int32())], fields=list(_LINK))
    list_at = np.searchsorted(place // p, np.arange(n + 1))
    told = segment.tolist()
    joined = [";".join(map(known.strings.__getitem__, told[s:e])) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in joined]
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(row, row + n)), pa.array(ids, pa.int64()), *[pa.array(total(x)) for x in (known.n_a, known.n_b, known.n_groups, known.n_overlaps, known.n_links)],
        pa.array(joined if with_groups else [None] * n, pa.string()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(list_at, pa.int32()), struct)],
        ["row", "doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups", "groups_sha256", "links"])


def load(folder: str) -> tuple[bytes, bytes]:
    return Path(folder, "byte_bpe_50k.json").read_bytes(), Path(folder, "piece_bpe_32k.model").read_bytes()


def align_texts(docs: DataFrame, folder: str = TOKENIZERS, with_groups: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), as ALIGNED; ``links`` are its linked id pairs with their occurrences.

    Tokenizer A encodes a space and the text, B puts the space there itself. A text that is null, empty, or not given back byte by byte
    by both has no tokens: zeros and ''. ``row`` tells rows apart once the result is written; doc_id may be null or repeated.
    ``groups`` (``a1,a2|b1;a3|b2,b3``) is null unless asked for. Other columns are ignored. Equal segments of a task are told by 64 bits of a hash.
    """
    files = docs.sparkSession.sparkContext.broadcast(load(folder))  # 2 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store = Store(ByteLevel(files.value[0]), Pieces(files.value[1]))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for first, last in blocks(texts):
                yield align_block(ids[first:last], texts.slice(first, last - first), store, row, with_groups)
                row += last - first

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): documents that hold a pair linked, and whether no other b is linked with a more often.

    Documents add up map-side, so a pair of a third of them is a row a task. ``best`` needs one number for each id of A's vocabulary.
    """
    counted = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = Workspace(aligned.sparkSession).keep(counted, "pairs")
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, folder: str = TOKENIZERS, heavy: int = HEAVY) -> DataFrame:
    """``align_texts`` without the links, with ``count_sum`` and ``n_best`` against the pair counts of the whole corpus.

    The most frequent pairs, at most ``heavy`` of them, meet the links where those are read; the others, each of
    fewer documents than any of these, by a shuffle on the pair. So neither a hot pair nor a large vocabulary meets one task.
    """
    space = Workspace(docs.sparkSession)
    aligned = space.keep(align_texts(docs, folder).drop("groups"), "aligned")
    counts = space.keep(pair_counts(aligned), "counts")
    scale = F.floor(F.log2("n_docs")).cast("int")
    sizes = {r["scale"]: r["n"] for r in counts.groupBy(scale.alias("scale")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 63, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > heavy:
            break
        least = s
    frequent, rare = counts.where(scale >= least), counts.where(scale < least)
    linked = aligned.select("row", F.inline("links"))
    got = [F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")]
    hot = linked.join(F.broadcast(frequent), ["a", "b"]).groupBy("row").agg(*got)
    cold = linked.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti").join(rare.hint("merge"), ["a", "b"]).groupBy("row").agg(*got)
    sums = hot.unionByName(cold).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return aligned.drop("links").join(sums, "row", "left").select(*[c for c in aligned.columns if c not in ("row", "links")], zero("count_sum"), zero("n_best"))

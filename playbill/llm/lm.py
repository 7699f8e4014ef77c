"""Language-model scoring: an n-gram model by deleted interpolation, fitted and applied to a whole corpus.

``P(w | h) = sum over k of weight[bucket][k] * p_k`` mixes the maximum-likelihood estimates of all
orders (``p_0`` is uniform over the vocabulary and one unknown word). The bucket tells how often the
longest known part of the context was seen; its weights are learned by expectation-maximisation on
held-out counts: the tuning documents' own counts are deleted from the tables their tokens
are looked up in. Scores then use the counts of all training documents.

How it runs. Texts become *chunks* of some million tokens: a vocabulary of hashes and a list of places in
it. A chunk asks for the counts of its distinct n-grams, once each however many documents hold them; the
questions go to shards, ranges of the hash space whose number follows the corpus. A shard adds up what all chunks
know about its n-grams and answers every question in the order it was put. So an n-gram that a third of all
documents hold travels once a chunk, no table of n-grams is broadcast, and no task holds more than a shard or a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.storage import Workspace
from playbill.llm.words import LOWER, STEPS, U64, Words, chunks, constants, mix

CHUNK_TOKENS = 1_000_000
SHARD_KEYS = 4_000_000
#: Hashes of the token that ends every text and of what stands before its first.
END, START = (constants(2, 11) & ~U64(1)).tolist()
#: Ratios p_k / p_0 of held-out tokens are counted on a grid of an eighth of an octave.
GRID, ZERO = 8, 1500
TUNE_SHARE, ROUNDS, MAX_ORDER = 8, 60, 4

STATE = "chunk bigint, tuning boolean, doc_ids array<bigint>, trains array<boolean>, lengths binary, vocab binary, ids binary, n_keys bigint"
QUESTIONS = "shard bigint, chunk bigint, tuning boolean, keys binary, counts binary"
ANSWERS = "chunk bigint, tuning boolean, shard bigint, fit binary, tune binary, totals array<bigint>"
SCORES = "doc_id bigint, trains boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes of the least width that holds the largest."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U64)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of every value among them)."""
    order = np.argsort(values)
    first = np.concatenate([[True], np.diff(values[order]) != 0])
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    return values[order[first]], place


class Grams:
    """The n-grams of a chunk's documents: ``keys``, distinct and in order, and ``places[k - 1][i]``, that of the k tokens which end at token i."""

    def __init__(self, vocab: np.ndarray, ids: np.ndarray, lengths: np.ndarray, order: int) -> None:
        self.lengths, self.first = lengths, np.cumsum(lengths) - lengths
        tokens, pad = vocab[ids], order - 1
        padded = np.full(len(ids) + pad * len(lengths), U64(START))
        at = np.arange(len(ids)) + pad * (np.repeat(np.arange(len(lengths)), lengths) + 1)
        padded[at] = tokens
        found = [(vocab, ids)]
        for k in range(2, order + 1):
            key = padded[at - k + 1] * STEPS[1]
            for j in range(1, k):
                key += padded[at - k + 1 + j] * STEPS[j + 1]
            found.append(ranked(mix(key) | U64(1)))
        self.keys = np.sort(np.concatenate([keys for keys, _ in found]))
        self.places = [np.searchsorted(self.keys, keys)[place] for keys, place in found]

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often the documents of ``wanted`` (a mask) hold each key."""
        own = np.repeat(wanted, self.lengths)
        return sum(np.bincount(place[own], minlength=len(self.keys)) for place in self.places)


class Buffer:
    """Documents of one chunk in the making."""

    def __init__(self) -> None:
        self.ids: list = []
        self.trains: list[bool] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, trains: bool, hashes: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.trains.append(trains)
        self.tokens.append(hashes)
        self.size += len(hashes)

    def row(self, chunk: int, tuning: bool, order: int) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, self.tokens), np.int64)
        words, place = ranked(np.concatenate(self.tokens))
        frequent = np.argsort(-np.bincount(place), kind="stable")  # frequent words get small numbers, which pack well
        number = np.empty(len(words), np.int64)
        number[frequent] = np.arange(len(words))
        vocab, ids = words[frequent], number[place]
        n_keys = len(vocab) + (order - 1) * len(ids)  # at most
        return pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), pa.array([tuning]), pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([self.trains], pa.list_(pa.bool_())), pa.array([pack(lengths)], pa.binary()),
            pa.array([pack(vocab)], pa.binary()), pa.array([pack(ids)], pa.binary()), pa.array([n_keys], pa.int64())],
            ["chunk", "tuning", "doc_ids", "trains", "lengths", "vocab", "ids", "n_keys"])


def chunk_texts(order: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts as rows of STATE, tuning documents in chunks of their own; a document is never divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_chunks = {False: Buffer(), True: Buffer()}
        end = np.array([END], U64)
        for batch in batches:
            ids, trains, tunes = (batch.column(c).to_pylist() for c in ("doc_id", "trains", "tunes"))
            for first, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, LOWER)
                hashes = words.hashes & ~U64(1)
                for i in range(len(offsets) - 1):
                    tuning = bool(tunes[first + i])
                    held = open_chunks[tuning]
                    held.add(ids[first + i], bool(trains[first + i]), np.concatenate([hashes[words.first[i] : words.first[i + 1]], end]))
                    if held.size >= size:
                        yield held.row(number, tuning, order)
                        number, open_chunks[tuning] = number + 1, Buffer()
        for tuning, held in open_chunks.items():
            if held.size:
                yield held.row(number, tuning, order)
                number += 1

    return run


def opened(row: dict, order: int) -> Grams:
    return Grams(unpack(row["vocab"]), unpack(row["ids"]).astype(np.int64), unpack(row["lengths"]).astype(np.int64), order)


def ask(order: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks as questions: the distinct n-grams of each shard, with their counts in the chunk's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = opened(row, order)
                keys, counts = grams.keys, grams.counts(np.array(row["trains"], bool))
                shard = ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
                parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard[cuts[:-1]], pa.int64()), pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([row["tuning"]] * len(parts)),
                    pa.array([pack_keys(keys[a:b]) for a, b in parts], pa.binary()), pa.array([pack(counts[a:b]) for a, b in parts], pa.binary())],
                    ["shard", "chunk", "tuning", "keys", "counts"])

    return run


def answer(questions: pa.Table) -> pa.Table:
    """All questions of a shard, with the corpus counts of their n-grams: in documents to fit on, and in tuning documents.

    A last row without a chunk tells what the shard adds to the sizes of the model: tokens and
    distinct words, of the fitted documents and of all.
    """
    shard, chunk, tuning = (questions.column(c).to_pylist() for c in ("shard", "chunk", "tuning"))
    asked = [unpack_keys(k) for k in questions.column("keys").to_pylist()]
    known = [unpack(c) for c in questions.column("counts").to_pylist()]
    ends = np.cumsum([len(k) for k in asked])
    keys, inverse = ranked(np.concatenate(asked))
    tuned = np.repeat(np.array(tuning, bool), [len(k) for k in asked])
    held = np.concatenate(known).astype(np.float64)
    fit = np.bincount(inverse, np.where(tuned, 0, held), len(keys)).astype(np.int64)
    tune = np.bincount(inverse, np.where(tuned, held, 0), len(keys)).astype(np.int64)
    words = keys & U64(1) == 0
    totals = [int(x) for x in (fit[words].sum(), (fit[words] > 0).sum(), (fit + tune)[words].sum(), ((fit + tune)[words] > 0).sum())]
    places = np.split(inverse, ends[:-1])
    return pa.Table.from_arrays([
        pa.array([*chunk, None], pa.int64()), pa.array([*tuning, None], pa.bool_()), pa.array([*shard, shard[0]], pa.int64()),
        pa.array([*[pack(fit[p]) for p in places], None], pa.binary()), pa.array([*[pack(tune[p]) for p in places], None], pa.binary()),
        pa.array([*[None] * len(chunk), totals], pa.list_(pa.int64()))], ["chunk", "tuning", "shard", "fit", "tune", "totals"])


class Lookup:
    """A chunk's tokens with their counts: ``grams[k - 1]`` and ``contexts[k - 1]`` of every token, by order k."""

    def __init__(self, state: pa.Table, answers: pa.Table, order: int, n_tokens: int, with_tuning: bool) -> None:
        self.row = state.to_pylist()[0]
        made = opened(self.row, order)
        self.lengths, self.first = made.lengths, made.first
        parts = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "fit", "tune")), strict=True))
        counts = np.concatenate([unpack(f) + (unpack(t) if with_tuning else U64(0)) for _, f, t in parts]).astype(np.int64)
        # Shards are ranges of the hash space, so their answers follow each other as the keys do.
        self.grams = [counts[place] for place in made.places]
        texts = self.grams[0][made.first[0] + made.lengths[0] - 1]  # how often the end was seen, which closes the chunk's first text too
        self.contexts = [np.full(len(self.grams[0]), n_tokens)]
        for g in self.grams[:-1]:
            before = np.concatenate([[0], g[:-1]])
            before[self.first] = texts  # what stands before a text was seen once a text
            self.contexts.append(before)

    def estimates(self) -> np.ndarray:
        """Maximum-likelihood estimates by order and token; 0 where the context was never seen."""
        return np.array([np.where(c > 0, g / np.maximum(c, 1), 0.0) for g, c in zip(self.grams, self.contexts, strict=True)])

    def buckets(self) -> np.ndarray:
        """64 * length of the longest context seen + floor(log2(how often))."""
        out = np.zeros(len(self.grams[0]), np.int64)
        for m, c in enumerate(self.contexts[1:], 1):
            out = np.where(c > 0, 64 * m + np.frexp(np.maximum(c, 1))[1] - 1, out)
        return out


def held_out_cells(order: int, n_tokens: int, n_words: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Tokens of a tuning chunk, looked up without the tuning documents, counted by bucket and grid."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if state.num_rows:
            look = Lookup(state, answers, order, n_tokens, with_tuning=False)
            cell = look.buckets()
            for p in look.estimates():
                code = np.round(GRID * np.log2(np.maximum(p, 1e-300) * (n_words + 1))).astype(np.int64) + ZERO
                cell = cell * 4096 + np.where(p > 0, np.clip(code, 1, 4095), 0)
            cells, counts = np.unique(cell, return_counts=True)
        return pa.Table.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], ["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, order: int) -> dict[int, list[float]]:
    """Weights of each bucket, for orders 0 to ``order``, by expectation-maximisation.

    A context of m known tokens defines the orders up to m + 1; the others weigh 0. One extra
    token is shared by a bucket's defined orders, so none of them gets the weight 0 by chance.
    """
    ratios = np.ones((order + 1, len(cells)))
    left = cells.copy()
    for k in range(order, 0, -1):
        code = left % 4096
        ratios[k] = np.where(code > 0, 2.0 ** ((code - ZERO) / GRID), 0.0)
        left //= 4096
    names, group = np.unique(left, return_inverse=True)
    defined = (np.arange(order + 1)[:, None] <= names // 64 + 1).astype(float)
    weights = defined / defined.sum(0)
    for _ in range(ROUNDS):
        parts = weights[:, group] * ratios
        shares = parts / parts.sum(0) * counts
        got = np.array([np.bincount(group, s, len(names)) for s in shares]) + defined / defined.sum(0)
        weights = got / got.sum(0)
    return {int(b): weights[:, i].tolist() for i, b in enumerate(names)}


def weights_of(buckets: np.ndarray, learned: dict[int, list[float]], order: int) -> np.ndarray:
    """By order and token. A bucket without held-out tokens takes the weights of the nearest with as long a context, else equal ones."""
    wanted, place = np.unique(buckets, return_inverse=True)
    rows = []
    for b in wanted.tolist():
        near = [a for a in learned if a // 64 == b // 64]
        rows.append(learned[min(near, key=lambda a: (abs(a - b), a))] if near else
                    [1 / (b // 64 + 2) if k <= b // 64 + 1 else 0.0 for k in range(order + 1)])
    return np.array(rows)[place].T


def scores(order: int, n_tokens: int, n_words: int, learned: dict[int, list[float]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.Table.from_pylist([], schema=SCORE_SCHEMA)
        look = Lookup(state, answers, order, n_tokens, with_tuning=True)
        weights = weights_of(look.buckets(), learned, order)
        p = weights[0] / (n_words + 1) + (weights[1:] * look.estimates()).sum(0)
        base = np.log10((look.grams[0] + 1) / (n_tokens + 1 * (n_words + 1)))
        add = lambda x: np.add.reduceat(x, look.first)
        return pa.Table.from_arrays([
            pa.array(look.row["doc_ids"], pa.int64()), pa.array(look.row["trains"]), pa.array(look.lengths), pa.array(add((look.grams[0] > 0).astype(np.int64))),
            pa.array(add(base)), pa.array(add(np.log10(p)))], schema=SCORE_SCHEMA)

    return run


SCORE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("trains", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_corpus(docs: DataFrame, trains: Column, order: int = 2, tunes: Column | None = None,
                 chunk_tokens: int = CHUNK_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Every document with the log10 probability of its text under a model learned from the documents of ``trains``.

    Result: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score. A token is a word, A-Z lower-cased, or
    the end that closes each text; ``base_score`` is that of add-one counts of single tokens. ``tunes`` picks the
    training documents that the weights are learned on (an eighth by hash of doc_id unless given). A null or empty text
    is its end alone. A null in ``trains`` or ``tunes`` counts as false; a null doc_id is kept, and rows with one doc_id are
    documents of their own. Other columns are ignored. With nothing to train on, all words are unknown and
    weights are equal. An empty table gives no row. Words and n-grams are told apart by 63 bits of a hash.
    """
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 1 to {MAX_ORDER}")
    space = Workspace(docs.sparkSession)
    learns = F.coalesce(trains, F.lit(False))
    tuned = F.pmod(F.xxhash64("doc_id"), F.lit(TUNE_SHARE)) == 0 if tunes is None else F.coalesce(tunes, F.lit(False))
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), learns.alias("trains"), (learns & tuned).alias("tunes"))
    state = space.keep(picked.mapInArrow(chunk_texts(order, chunk_tokens), STATE), "chunks")
    shards = max(1, -(-(state.agg(F.sum("n_keys").alias("n")).first()["n"] or 0) // shard_keys))
    questions = state.select("chunk", "tuning", "trains", "lengths", "vocab", "ids").mapInArrow(ask(order, shards), QUESTIONS)
    answers = space.keep(questions.groupBy("shard").applyInArrow(answer, ANSWERS), "answers")
    sums = answers.where("chunk IS NULL").agg(*[F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(4)]).first()
    fit_tokens, fit_words, n_tokens, n_words = (int(x or 0) for x in sums)

    def together(fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, only: Column) -> DataFrame:
        asked = answers.where(F.col("chunk").isNotNull() & only).select("chunk", "shard", "fit", "tune")
        return state.where(only).drop("n_keys", "tuning").groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(fn, schema)

    # A cell is a bucket and a place on the grid, so their number has a bound that the corpus does not move.
    cells = together(held_out_cells(order, fit_tokens, fit_words), "cell bigint, n bigint", F.col("tuning"))
    met = cells.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    learned = learn_weights(np.array([r["cell"] for r in met], np.int64), np.array([r["n"] for r in met], np.int64), order)
    scored = together(scores(order, n_tokens, n_words, learned), SCORES, F.lit(True))
    return scored.withColumn("train_tokens", F.lit(n_tokens).cast("bigint"))

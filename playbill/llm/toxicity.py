"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each model is a logistic
regression over the words of a text and a few shares of its bytes, and over the
probabilities of the categories before it. Training takes those probabilities from
models that have not seen the row (out of fold), so a later model learns how far to
trust them; predicting takes them from the models fitted on the whole sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.llm.storage import clean_columns
from playbill.llm.words import CLEAN, U64, Words, chunks

BITS, SAMPLE_ROWS, FOLDS, FEATURES = 18, 16_384, 5, 4096
DENSE = 4


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word buckets, shares) of each text: symbols, capitals, distinct words, and a length measure."""
    for _, data, offsets in chunks(column):
        w = Words(data, offsets, CLEAN)
        bucket = (w.hashes >> U64(64 - BITS)).astype(np.int64)
        capital, symbol = (data >= 65) & (data <= 90), np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (capital, symbol)]
        for d in range(len(w.counts)):
            own = np.unique(bucket[w.first[d] : w.first[d + 1]])
            a, b = offsets[d], offsets[d + 1]
            n = max(1, b - a)
            yield own, np.array([(sums[1][b] - sums[1][a]) / n * 10, (sums[0][b] - sums[0][a]) / n,
                                 len(own) / max(1, w.counts[d]), np.log1p(w.counts[d]) / 10])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Linear:
    """Weights by word bucket, by dense column, and the intercept."""

    words: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, index: np.ndarray, owner: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(owner, self.words[index], len(dense)) + dense @ self.dense + self.bias)


def fit(index: np.ndarray, owner: np.ndarray, dense: np.ndarray, y: np.ndarray, features: int = FEATURES,
        steps: int = 150, penalty: float = 1e-4) -> Linear:
    """Logistic regression on the ``features`` word buckets that tell the classes apart best, by AdaGrad over all rows.

    Without rows of both classes the probability is the smoothed share of positives.
    """
    n, positive = len(y), float(y.sum())
    out = Linear(np.zeros(1 << BITS), np.zeros(dense.shape[1]), float(np.log((positive + 0.5) / (n - positive + 0.5))))
    if positive == 0 or positive == n:
        return out
    with_y = np.bincount(index, y[owner], 1 << BITS)
    seen = np.bincount(index, minlength=1 << BITS)
    expected = seen * positive / n
    gain = np.where(seen >= 3, (with_y - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    chosen = np.argsort(-gain, kind="stable")[:features]
    chosen = chosen[gain[chosen] > 0]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[index] >= 0
    column, row = place[index[use]], owner[use]
    w, v, b = np.zeros(len(chosen)), out.dense, out.bias
    total = [np.full(len(w), 1e-8), np.full(len(v), 1e-8), 1e-8]
    for _ in range(steps):
        error = (sigmoid(np.bincount(row, w[column], n) + dense @ v + b) - y) / n
        slopes = [np.bincount(column, error[row], len(w)) + penalty * w, error @ dense + penalty * v, float(error.sum())]
        total = [t + g * g for t, g in zip(total, slopes, strict=True)]
        w, v, b = (x - 0.5 * g / np.sqrt(t) for x, g, t in zip((w, v, b), slopes, total, strict=True))
    out.words[chosen], out.dense, out.bias = w, v, b
    return out


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that separates best by F1, halfway to the next lower one; over 1 if there is nothing to find."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][best] + p[order][min(best + 1, len(p) - 1)]) / 2)


@dataclass
class Chain:
    labels: list[str]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, index: np.ndarray, owner: np.ndarray, dense: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for model in self.models:
            out.append(model.score(index, owner, np.column_stack([dense, *out])))
        return out


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, list[int]]], labels: list[str], folds: int = FOLDS) -> Chain:
    """A chain over ``labels`` in their order, from (buckets, dense, values of the labels)."""
    chain = Chain(labels, [], [])
    if not rows:
        for j in range(len(labels)):
            chain.models.append(Linear(np.zeros(1 << BITS), np.zeros(DENSE + j), -35.0))
            chain.thresholds.append(2.0)
        return chain
    counts = np.array([len(r[0]) for r in rows])
    index, owner = np.concatenate([r[0] for r in rows]).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    dense = np.stack([r[1] for r in rows])
    fold = np.arange(len(rows)) % folds
    for j in range(len(labels)):
        y = np.array([r[2][j] for r in rows], float)
        unseen = np.zeros(len(rows))
        for f in range(folds):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(train) or not len(test):
                continue
            model = fit(*_subset(index, owner, train, len(rows)), dense[train], y[train])
            unseen[test] = model.score(*_subset(index, owner, test, len(rows)), dense[test])
        chain.models.append(fit(index, owner, dense, y))
        chain.thresholds.append(threshold(unseen, y))
        dense = np.column_stack([dense, unseen])
    return chain


def _subset(index: np.ndarray, owner: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.full(n, -1, np.int32)
    place[rows] = np.arange(len(rows))
    use = place[owner] >= 0
    return index[use], place[owner[use]]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(features(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
             pa.array([f[1].astype(np.float64).tobytes() for f in found], pa.binary())], names=[*[c for c in batch.schema.names if c != "text"], "_buckets", "_dense"])


def fit_chain(docs: DataFrame, labelled: DataFrame, labels: list[str], sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain:
    """A chain fitted on at most ``sample_rows`` labelled documents, those whose doc_id has the smallest hash.

    ``labelled`` has doc_id and a 0/1 column for each label. Rows with a null in any of them do not count;
    of several rows for a document the largest value does. The bound is on rows: what reaches the driver is their
    distinct word buckets. Without labelled rows every probability is 0.
    """
    held = labelled.dropna(subset=["doc_id", *labels]).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in labels])
    drawn = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    schema = T.StructType([f for f in text.schema.fields if f.name != "text"]).add("_buckets", T.BinaryType()).add("_dense", T.BinaryType())
    rows = sorted(text.mapInArrow(_vectors, schema).collect(), key=lambda r: (r["doc_id"], bytes(r["_buckets"])))
    return fit_rows([(np.frombuffer(r["_buckets"], np.int32), np.frombuffer(r["_dense"]), [r[c] for c in labels]) for r in rows], labels, folds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds ``p_<label>`` and the boolean ``<label>`` for each label of the chain, over whole texts.

    A null or empty text has no words and is judged by the intercepts. Input columns of the added names are
    dropped; repeated rows are judged alike; an empty table gives an empty result. The models, 2**BITS weights
    for each label, travel to the tasks; nothing is shuffled.
    """
    added = [f"p_{c}" for c in chain.labels] + chain.labels
    base = docs.select(*clean_columns(docs, added))
    schema = T.StructType(list(base.schema.fields))
    for c in added:
        schema = schema.add(c, T.BooleanType() if c in chain.labels else T.DoubleType())
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = list(features(batch.column("text")))
            if found:
                index, owner = np.concatenate([f[0] for f in found]), np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                p = model.predict(index, owner, np.stack([f[1] for f in found]))
            else:
                p = [np.zeros(0) for _ in model.labels]
            flags = [x >= t for x, t in zip(p, model.thresholds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in p], *[pa.array(x, pa.bool_()) for x in flags]], names=[*batch.schema.names, *added])

    return base.mapInArrow(judge, schema)

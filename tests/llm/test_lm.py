"""Scores against a model counted and trained in plain dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from playbill.llm import lm
from playbill.llm import queries as q

FOLDER = "/root/testdata/sf0.001"
END, START = ("end",), ("start",)


def words(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        small = small.replace(c, " ")
    return [w for w in small.split(" ") if w] + [END]


def plain_model(rows, order, tunes, grid=8):
    """rows: (doc_id, text, trains). Scores by row, as the documentation of the operator says, without chunks, shards or hashes."""
    def count(texts):
        grams, contexts = Counter(), Counter()
        for t in texts:
            full = [START] * (order - 1) + words(t)
            for i in range(order - 1, len(full)):
                for k in range(1, order + 1):
                    grams[tuple(full[i - k + 1 : i + 1])] += 1
                    contexts[tuple(full[i - k + 1 : i])] += 1
        return grams, contexts, len({g for g in grams if len(g) == 1})

    def events(text, model):
        grams, contexts, _ = model
        full = [START] * (order - 1) + words(text)
        for i in range(order - 1, len(full)):
            known = [contexts[tuple(full[i - m : i])] for m in range(order)]
            p = [grams[tuple(full[i - k + 1 : i + 1])] / known[k - 1] if known[k - 1] else 0.0 for k in range(1, order + 1)]
            longest = max([m for m in range(1, order) if known[m]], default=0)
            yield 64 * longest + int(math.log2(known[longest])) if longest else 0, p, grams[(full[i],)]

    fit = count([t for d, t, learns in rows if learns and not tunes(d)])
    cells = {}
    for d, t, learns in rows:
        if learns and tunes(d):
            for b, p, _ in events(t, fit):
                ratios = tuple(2 ** (round(grid * math.log2(x * (fit[2] + 1))) / grid) if x else 0.0 for x in p)
                cells.setdefault(b, Counter())[ratios] += 1
    weights = {}
    for b, met in cells.items():
        n = b // 64 + 2
        lam = [1 / n] * n + [0.0] * (order + 1 - n)
        for _ in range(60):
            got = [1 / n if k < n else 0.0 for k in range(order + 1)]
            for r, c in met.items():
                parts = [a * x for a, x in zip(lam, (1.0, *r))]
                for k, x in enumerate(parts):
                    got[k] += c * x / sum(parts)
            lam = [g / sum(got) for g in got]
        weights[b] = lam
    full = count([t for _, t, learns in rows if learns])
    total = sum(c for g, c in full[0].items() if len(g) == 1)
    out = []
    for d, t, learns in rows:
        score = base = 0.0
        known = n_tokens = 0
        for b, p, c in events(t, full):
            near = [a for a in weights if a // 64 == b // 64]
            n = b // 64 + 2
            lam = weights[min(near, key=lambda a: (abs(a - b), a))] if near else [1 / n] * n + [0.0] * (order + 1 - n)
            score += math.log10(lam[0] / (full[2] + 1) + sum(a * x for a, x in zip(lam[1:], p)))
            base += math.log10((c + 1) / (total + full[2] + 1))
            n_tokens, known = n_tokens + 1, known + (c > 0)
        out.append((d, learns, n_tokens, known, total, base, score))
    return out


def close(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-7, abs=1e-7)


COLUMNS = ["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize(("order", "chunk", "shard"), [(1, 10_000, 5_000), (2, 2_000_000, 4_000_000), (2, 500, 700), (3, 3_000, 9_000)])
def test_equals_plain_model(spark, order, chunk, shard):
    docs = q.read(spark, FOLDER, "documents")
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in docs.collect()]
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    done = lm.score_corpus(docs, trains, order, F.col("doc_id") % 8 == 3, chunk, shard).select(COLUMNS)
    close(done.collect(), plain_model(rows, order, lambda d: d % 8 == 3))


def test_query_columns_and_better_than_base(spark):
    rows = q.QUERIES["op11_lm_scoring"](spark, FOLDER).collect()
    assert set(rows[0].asDict()) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert 0 < len(held) < len(rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert {r["train_tokens"] for r in rows} == {sum(r["n_tokens"] for r in rows if not r["held_out"])}


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, True), (2, "", True), (3, " \n\t ", False), (4, "a A a", True), (4, "a A a", True), (None, "a b", True),
            (None, "zz", False), (7, long, True), (8, "ü Ü ü", False), (16, "a b c", True)]
    docs = spark.createDataFrame([(d, t, x, "clash", 5) for d, t, x in rows], "doc_id bigint, text string, learn boolean, chunk string, SCORE int")
    done = lm.score_corpus(docs, F.col("learn"), 2, F.col("doc_id") == 16, 20, 50).select(COLUMNS)
    close(done.collect(), plain_model(rows, 2, lambda d: d == 16))


def test_nothing_to_train_on_or_to_tune_on(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = {r["doc_id"]: r for r in lm.score_corpus(docs, F.lit(None).cast("boolean")).collect()}
    assert [(none[i]["n_tokens"], none[i]["n_known"], none[i]["train_tokens"], none[i]["base_score"]) for i in (1, 2)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in none.values())
    close(lm.score_corpus(docs, F.lit(True), 2, F.lit(False)).select(COLUMNS).collect(),
          plain_model([(1, "a b", True), (2, None, True)], 2, lambda d: False))
    assert lm.score_corpus(docs.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        lm.score_corpus(docs, F.lit(True), 0)


def test_probabilities_of_a_context_add_up_to_one(spark):
    """One-word texts over the whole vocabulary, an unknown word and the empty text share one context."""
    vocab = ["a", "b", "c", "d"]
    train = [(i, " ".join(vocab[(i * j) % 4] for j in range(i % 5))) for i in range(64)]
    asked = [(100 + i, w) for i, w in enumerate([*vocab, "never"])]
    docs = spark.createDataFrame(train + asked + [(200, "")], "doc_id bigint, text string")
    done = {r["doc_id"]: r["score"] for r in lm.score_corpus(docs, F.col("doc_id") < 100, 1).collect()}
    end = 10 ** done[200]
    assert sum(10 ** done[100 + i] / end for i in range(5)) + end == pytest.approx(1.0)


@pytest.mark.parametrize("values", [[], [0], [5, 0, 2**63 + 1], list(range(1000))])
def test_packing_round_trip(values):
    assert lm.unpack(lm.pack(np.array(values, np.uint64))).tolist() == values
    assert lm.unpack_keys(lm.pack_keys(np.array(sorted(values), np.uint64))).tolist() == sorted(values)


def test_the_grid_hardly_moves_the_weights():
    rng = np.random.default_rng(5)
    p = 2.0 ** rng.uniform(-3, 12, 4000)
    p[rng.random(4000) < 0.4] = 0

    def weights(step):
        code = np.where(p > 0, np.round(lm.GRID * np.log2(np.maximum(p, 1e-9)) / step) * step + lm.ZERO, 0).astype(np.int64)
        cells, n = np.unique(code, return_counts=True)
        return lm.learn_weights(cells, n, 1)[0]

    assert weights(1) == pytest.approx(weights(4), abs=0.02)

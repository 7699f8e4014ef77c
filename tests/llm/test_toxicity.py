import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playbill.llm import toxicity as tx
from playbill.llm.queries import CATEGORIES, read

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Fitted on three of five labelled documents, judged on the others."""
    docs = read(spark, FOLDER, "documents")
    labels = read(spark, FOLDER, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = tx.fit_chain(docs, labels.where("doc_id % 5 < 3"), CATEGORIES)
    judged = tx.score(docs, chain).join(labels.where("doc_id % 5 >= 3").withColumnsRenamed({"low_quality": "y0", "toxic": "y1"}), "doc_id").collect()
    for c, y in zip(CATEGORIES, ("y0", "y1")):
        hit, said, true = (sum(f(r) for r in judged) for f in (lambda r: r[c] and r[y] == 1, lambda r: r[c], lambda r: r[y] == 1))
        assert hit / said > 0.85 and hit / true > 0.85


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        insult, threat = i % 3 == 0, i % 6 == 0
        text = [f"w{rng.randrange(50)}" for _ in range(20)] + ["fool"] * insult + ["beware"] * threat
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult), int(threat)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, insult int, threat int")


def test_later_models_use_earlier_categories(small):
    chain = tx.fit_chain(small, small.drop("text"), ["insult", "threat"])
    assert [len(m.dense) for m in chain.models] == [tx.DENSE, tx.DENSE + 1]
    rows = tx.score(small.select("doc_id", "text"), chain).collect()
    assert all(r["insult"] == (r["doc_id"] % 3 == 0) and r["threat"] == (r["doc_id"] % 6 == 0) for r in rows)


def test_out_of_fold_probabilities_come_from_models_that_did_not_see_the_row(monkeypatch):
    """With labels that are noise, a model's own rows look certain; rows it has not seen do not."""
    rng = np.random.default_rng(1)
    rows = [(np.array([i, 500 + i % 3]), np.zeros(tx.DENSE), [int(rng.integers(2)), int(rng.integers(2))]) for i in range(100)]
    seen = []
    fit = tx.fit
    monkeypatch.setattr(tx, "fit", lambda index, owner, dense, y, **kw: seen.append(dense.copy()) or fit(index, owner, dense, y, **kw))
    tx.fit_rows(rows, ["a", "b"])
    assert len(seen) == 12 and seen[-1].shape == (100, tx.DENSE + 1)
    assert abs(seen[-1][:, -1] - 0.5).max() < 0.45


def test_edges(spark, small, documents):
    chain = tx.fit_chain(small, small.drop("text"), ["insult"])
    docs = documents([(1, None), (2, ""), (3, "fool " * 300_000), (4, "w1 w2"), (4, "w1 w2"), (None, "you FOOL!")]).withColumns({"P_INSULT": F.lit(1), "insult": F.lit(2)})
    out = tx.score(docs, chain)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "p_insult", "insult"]
    assert sorted((r["doc_id"] or 0, r["insult"]) for r in out.collect()) == [(0, True), (1, False), (2, False), (3, True), (4, False), (4, False)]


def test_no_labels_one_class_nulls_and_the_bound(spark, small):
    none = tx.fit_chain(small, small.drop("text").where("false"), ["insult"])
    assert not any(r["insult"] for r in tx.score(small.select("doc_id", "text"), none).collect())
    one = tx.fit_chain(small, small.drop("text").where("insult = 0"), ["insult"])
    assert max(r["p_insult"] for r in tx.score(small.select("doc_id", "text"), one).collect()) < 0.1
    nulls = small.select("doc_id", F.when(F.col("doc_id") < 300, F.col("insult")).alias("insult"))
    assert tx.fit_chain(small, nulls.union(nulls), ["insult"], sample_rows=50).models


def test_threshold():
    assert 0.4 < tx.threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) < 0.6
    assert tx.threshold(np.array([0.9]), np.array([0.0])) > 1
    assert tx.threshold(np.array([0.5, 0.5]), np.array([1.0, 0])) == 0.5


def test_features_of_whole_texts():
    (own, dense), = tx.features(pa.array(["A b, a!"]))
    assert len(own) == 2 and dense[2] == pytest.approx(2 / 3)

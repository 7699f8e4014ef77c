import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playbill.llm import neardup as nd


def shingles(text):
    own = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if x]
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())


def brute(docs):
    docs = [(i, shingles(t)) for i, t in docs if i is not None]
    label = {i: i for i, _ in docs}
    changed = True
    links = [(i, j) for i, a in docs for j, b in docs if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {(i, len(s), label[i], label[i] == i) for i, s in docs}


def family(rng, base, n, edits, first):
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(text)))
    return out


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(9)
    docs = []
    for f in range(12):
        docs += family(rng, [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))], 18, 8, f * 100)
    docs += [(5000 + i, "passage that many share here " * 3 + " ".join(f"q{rng.randrange(10**6)}" for _ in range(20))) for i in range(40)]
    docs += [(7000, None), (7001, ""), (7002, " \n "), (7003, "Two words"), (7004, "two\tWORDS"), (7005, "other words"), (6000, docs[3][1].upper()), (None, docs[3][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_brute_force(documents, fixture, monkeypatch, block):
    """Also with blocks so small that buckets are split and families are compared block by block."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = nd.near_duplicates(documents(fixture)).collect()
    assert {tuple(r) for r in rows if r["doc_id"] is not None} == brute(fixture)
    assert [tuple(r)[2:] for r in rows if r["doc_id"] is None] == [(None, True)] and len(rows) == len(fixture)


def test_the_threshold_itself_is_a_link(documents):
    """3 of 4 shingles shared by both, 4 in the union: exactly 75 %."""
    docs = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "z a b c d e f g"), (4, "a b c d e f")]
    assert {(r["doc_id"], r["component_id"]) for r in nd.near_duplicates(documents(docs)).collect()} == {(a, c) for a, _, c, _ in brute(docs)}


def test_repeated_rows_long_texts_and_extra_columns(documents):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = documents([(1, long), (1, long), (2, long + " end"), (3, "x y"), (3, "another text")]).withColumn("KEPT", F.lit(1))
    rows = sorted(tuple(r) for r in nd.near_duplicates(docs).collect())
    assert rows == [(1, 299_996, 1, True)] * 2 + [(2, 299_997, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    assert nd.drop_near_duplicates(docs).columns == docs.columns and nd.drop_near_duplicates(docs).count() == 4


def test_a_pair_at_the_threshold_shares_a_bucket():
    assert (1 - 0.75**nd.ROWS) ** nd.BANDS < 1e-6


def test_exact_links_of_many_equal_a_direct_count():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 22).astype(np.uint64)) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    got = list(nd.exact_links(sets, np.zeros(40, int), 75, 100, True))
    assert {tuple(sorted(x, reverse=True)) for x in got} <= want
    label = {i: i for i in range(40)}
    for pairs in (want, got):
        seen = dict(label)
        for _ in range(40):
            for i, j in pairs:
                seen[i] = seen[j] = min(seen[i], seen[j])
        label_of = seen if pairs is want else label_of
        assert seen == label_of


def test_a_split_bucket_compares_nodes_taken_in_with_nodes_left_out(spark, monkeypatch):
    """Signatures that share one band only. The pivot takes in 1 and not 2, which are similar to each other."""
    monkeypatch.setattr(nd, "BLOCK", 1)
    low = np.random.default_rng(3).integers(0, 16, nd.HASHES)
    apart = (low + 1 + np.arange(nd.HASHES) % 7) % 16
    rows = np.stack([low, np.where(np.arange(nd.HASHES) < 46, low, apart), np.where(np.arange(nd.HASHES) < 36, low, apart), *[low] * 20])
    far = 1 - nd.estimate(rows, rows[0])
    assert 0.85 < far[1] <= 0.9 < far[2] and nd.estimate(rows[1], rows[2]) > 0.9
    # The high bits tell all bands but the first apart.
    rows = (rows + 16 * np.arange(len(rows))[:, None] * (np.arange(nd.HASHES) >= nd.ROWS)).astype(np.uint16)
    nodes = spark.createDataFrame([(i, 100, bytearray(r.tobytes())) for i, r in enumerate(rows)], "id bigint, n_shingles bigint, minima binary")
    found = {r["id"]: r["component"] for r in nd._families(nodes, 0.75, nd.Workspace(spark)).collect()}
    assert {found.get(i, i) for i in range(len(rows))} == {0}


def test_minima_tell_unrelated_long_texts_apart():
    texts = [" ".join(f"{name}{i}" for i in range(80_000)) for name in "vw"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["doc_id", "text"])
    minima = [np.frombuffer(m.as_py(), np.uint16) for b in nd.sign(iter([batch])) for m in b.column("minima")]
    assert (minima[0] == minima[1]).mean() < 0.02 and nd.estimate(*[nd._nibbles(m) for m in minima]) < nd.SLACK

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playbill.llm import lines as ln
from playbill.llm.cuckoo import CuckooFilter

LONG = "This line has more than forty characters in it, number "


def brute(docs, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        stay = [x for x in own if not (len(held[key(x)]) >= min_docs and max(held[key(x)], key=lambda d: (d is not None, d)) != i)]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    pool = [f"{LONG}{i}" for i in range(12)] + ["short line", "", "  ", "é" * 40, "x" * 39]
    docs = [(i, "\n".join(rng.choice(["", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) + rng.choice(["", " \r"]) for _ in range(rng.randrange(8)))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "\n\n"), (None, pool[0] + "\n" + pool[1]), (103, "\n".join([pool[2]] * 5)), (104, "\n".join(pool) * 2000)]


def rows(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=str)


def test_equals_brute_force(documents):
    assert rows(ln.dedup_lines(documents(corpus()))) == brute(corpus())


def test_many_shards_and_filters_joined_instead_of_broadcast(documents, monkeypatch):
    probe = ln.probe
    monkeypatch.setattr(ln, "probe", lambda a, b, c: probe(a, b, c, most_bytes=0))
    assert rows(ln.dedup_lines(documents(corpus()), shard_keys=2)) == brute(corpus())


def test_repeated_rows_and_columns(documents):
    docs = [(i, f"{LONG}0\nown {i}") for i in range(5)]
    table = documents(docs + docs + [(4, f"{LONG}0\nanother text")]).withColumn("N_LINES", F.lit("old"))
    out = ln.dedup_lines(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped", "kept_text"]
    assert rows(out) == brute(docs + docs + [(4, f"{LONG}0\nanother text")])


def test_insertions_and_deletions_are_undone_by_each_other(spark, documents, tmp_path):
    old, new = documents([(i, f"{LONG}0\n{LONG}1") for i in range(6)]), documents([(i, f"{LONG}1\n{LONG}2") for i in range(10, 16)])
    index = ln.LineIndex(spark, str(tmp_path / "log"))
    state = lambda i: sorted(tuple(r) for r in ln.counts(i.log()).collect())
    index.insert(old)
    before = state(index)
    index.insert(new)
    both = state(index)
    assert {r[2:] for r in both} == {(6, 5), (12, 15), (6, 15)}
    index.delete(new)
    assert state(index) == before
    index.insert(new)
    index.delete(old)
    index.insert(old)
    assert state(index) == both and state(index.compact(str(tmp_path / "small"))) == both
    fresh = documents([(99, f"{LONG}1\n{LONG}2\nnew")])
    assert rows(ln.dedup_lines(fresh, index.log()))[0][2:] == (2, "new")


def test_filters_forget_deleted_keys(spark, documents):
    docs = documents([(i, f"{LONG}{i % 4}") for i in range(40)])
    frequent = ln.counts(ln.insertions(docs)).where("n_docs >= 5")
    stored = ln.filters(frequent, 2)
    gone = frequent.limit(2)
    left = ln.apply_deletions(stored, gone, 2).collect()
    lost = {(r["a"], r["b"] % 2) for r in gone.collect()}
    for r in left:
        made = CuckooFilter.load(bytes(r["filter"]))
        own = [x["a"] for x in frequent.collect() if x["b"] % 2 == r["shard"]]
        stay = np.array([a for a in own if (a, r["shard"]) not in lost], np.int64).view(np.uint64)
        assert made.contains(stay).all() and int((made.table > 0).sum()) == len(stay)


@pytest.mark.parametrize("n", [0, 1, 3, 100, 5000])
def test_cuckoo_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    made = CuckooFilter.load(CuckooFilter.of(keys).dump())
    assert made.contains(keys).all()
    others = np.random.default_rng(99).integers(0, 2**63, 20_000).astype(np.uint64)
    assert made.contains(others).mean() < 0.001
    made.delete(keys[: n // 2])
    assert made.contains(keys[n // 2 :]).all() and int((made.table > 0).sum()) == n - n // 2
    assert made.insert(keys[: n // 2]) and made.contains(keys).all()

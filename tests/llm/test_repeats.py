import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill.llm import repeats as rp
from playbill.llm import storage


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def got(df, **kw):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rp.remove_repeats(df, **kw).collect()}


def corpus():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [say(rng.randrange(20, 90)) for _ in range(6)]
    texts = [None, "", "x", "a" * 300, "a" * 25, "ab" * 60, "é" * 40]
    texts += ["".join(rng.choice([say(rng.randrange(40)), rng.choice(shared), rng.choice(shared)[3:-2]]) for _ in range(rng.randrange(5))) for _ in range(120)]
    return texts + [texts[20], texts[21], texts[30] + "tail", "head" + texts[30]]


@pytest.mark.parametrize("hot", [10**6, 2])
def test_equals_brute_force(documents, hot):
    """Also with groups so small that most count as hot and are dealt out in bands."""
    texts = corpus()
    assert got(documents(enumerate(texts)), length=20, gram=8, hot=hot) == dict(enumerate(brute(texts, 20)))


def test_shuffle_join_instead_of_broadcast(documents, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", 0)
    texts = corpus()[:60]
    assert got(documents(enumerate(texts)), length=20, gram=8) == dict(enumerate(brute(texts, 20)))


def test_long_texts_are_read_in_pieces(documents, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(rp, "PIECE", 500)
    say = "".join(rng.choice("abcdefgh") for _ in range(3000))
    texts = [say, say[490:620], "zz" + say[1400:1450], "a" * 2000]
    assert got(documents(enumerate(texts)), length=20, gram=8) == dict(enumerate(brute(texts, 20)))


def test_production_length(documents):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = say(200), say(199)
    texts = ["1" + a + "2", "3" + a + "4", "5" + b + "6", "7" + b + "8", a[:-1], say(5000)]
    assert got(documents(enumerate(texts))) == dict(enumerate(brute(texts, 200)))


def test_repeated_rows_nulls_and_clashing_columns(documents):
    text = "this text stands in the table twice and so all of it is gone"
    docs = documents([(1, text), (1, text), (None, "unique " * 2), (2, None)]).withColumn("N_BYTES", F.lit("old")).withColumn("_key", F.lit(0))
    out = rp.remove_repeats(docs, length=20, gram=8)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out.collect()) == [(0, 0), (1, len(text)), (1, len(text)), (2, 0)]


def test_no_group_grows_with_the_holders_of_one_passage(documents, monkeypatch):
    """One passage in different surroundings, all different, and with edges that a few holders share."""
    rng = random.Random(10)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, edges, longest = say(30), [say(3) for _ in range(4)], rp.longest_repeats

    def bounded(lefts, rights, length):
        assert len(rights) <= 10
        return longest(lefts, rights, length)

    monkeypatch.setattr(rp, "longest_repeats", bounded)
    texts = [say(25) + passage + say(25) for _ in range(80)] + [say(20) + rng.choice(edges) + passage + rng.choice(edges) + say(20) for _ in range(40)]
    texts += [passage + say(15), say(15) + passage, passage, texts[0], texts[90]]
    assert got(documents(enumerate(texts)), length=20, gram=8, hot=10) == dict(enumerate(brute(texts, 20)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: bytes(x % 2 for x in b)), st.binary(max_size=8).map(lambda b: bytes(x % 2 for x in b))), min_size=2, max_size=9))
def test_longest_repeats_cover_what_pairs_share(rows):
    length = 6
    rights = [b"anc" + r for _, r in rows]
    lefts = [left for left, _ in rows]
    want = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j:
                l, r = rp.common(lefts[i], lefts[j]), rp.common(rights[i], rights[j])
                if l + r >= length:
                    want[i] |= set(range(-l, r))
    have = [set() for _ in rows]
    for k, l, r in rp.longest_repeats(lefts, rights, length):
        have[k] |= set(range(-l, r))
    assert have == want


def test_interval_tree():
    order, prefix = rp.suffix_array([b"banana"[i:] for i in range(6)])
    assert [b"banana"[i:] for i in order] == [b"a", b"ana", b"anana", b"banana", b"na", b"nana"]
    assert list(rp.intervals(prefix, 1)) == [(1, 2, 3), (0, 2, 1), (4, 5, 2)]


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 5, 97):
        assert rp.sliding(x, width, np.minimum).tolist() == [min(x[i : i + width]) for i in range(97 - width + 1)]

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playbill.llm import words as w

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def found(texts, mapping=w.LOWER):
    out = []
    for _, data, offsets in w.chunks(pa.array(texts, pa.string())):
        own = w.Words(data, offsets, mapping)
        for a, b in zip(own.first, own.first[1:]):
            out.append([bytes(own.data[s:e]) for s, e in zip(own.starts[a:b], own.ends[a:b])])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB \n\t\x0b\x0c\ré€\x85\xa0", max_size=20), max_size=10))
def test_words_of_texts(texts):
    want = [[x.lower() for x in WORD.findall((t or "").encode())] for t in texts]
    assert found(texts) == want


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_chunks_hold_whole_texts(monkeypatch, chunk):
    monkeypatch.setattr(w, "CHUNK", chunk)
    monkeypatch.setattr(w, "_powers", {})
    texts = ["", "a b", None, "c" * 50, " ", "d e f"]
    assert found(texts) == [[], [b"a", b"b"], [], [b"c" * 50], [], [b"d", b"e", b"f"]]
    sliced = pa.array(texts).slice(1, 4)
    assert sum(len(o) - 1 for _, _, o in w.chunks(sliced)) == 4


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = ["alpha beta", "x " * 1000 + "Alpha", "ALPHA", "beta alpha"]
    hashes = [list(w.Words(d, o, w.LOWER).hashes) for t in texts for _, d, o in w.chunks(pa.array([t]))]
    assert hashes[0][0] == hashes[1][-1] == hashes[2][0] == hashes[3][1] != hashes[0][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=40), min_size=1, max_size=5))
def test_shingle_sets(texts):
    def shingles(t):
        own = t.split()
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())

    sets = list(w.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for a, x in zip(texts, sets):
        for b, y in zip(texts, sets):
            assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b))

"""Alignments against plain loops over whole documents, encoded by the tokenizers' own libraries."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import align
from playbill.llm import queries as q

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(f"{align.TOKENIZERS}/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/piece_bpe_32k.model")
        taken = {*range(33, 127), *range(161, 173), *range(174, 256)}
        letters = {chr(b): b for b in taken}
        for b in range(256):
            if b not in taken:
                letters[chr(256 + len(letters) - len(taken))] = b
        vocab = json.load(open(f"{align.TOKENIZERS}/byte_bpe_50k.json"))["model"]["vocab"]
        self.a_bytes = {i: bytes(letters[c] for c in e) if e != "<|endoftext|>" else b"" for e, i in vocab.items()}

    def b_bytes(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def document(self, text):
        """(a ids, b ids, groups as pairs of id lists, overlaps), or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return None
        ends = [np.cumsum([len(t) for t in s]) for s in (x, y)]
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        groups, at = [], (0, 0)
        for e in both:
            to = (ends[0].tolist().index(e, at[0]) + 1, ends[1].tolist().index(e, at[1]) + 1) if len(a) < 300 else tuple(int(np.searchsorted(x, e)) + 1 for x in ends)
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        overlaps = sum(max(s, t) < min(e, f) for s, e in zip([0, *ends[0]], ends[0]) for t, f in zip([0, *ends[1]], ends[1])) if len(a) < 100 else None
        return a, b, groups, overlaps

    def corpus(self, rows):
        told = [(d, self.document(t)) for d, t in rows]
        held, links = Counter(), []
        for _, done in told:
            own = Counter((x, y) for g in done[2] for x in g[0] for y in g[1]) if done else Counter()
            links.append(own)
            held.update(own.keys())
        best = defaultdict(int)
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        out = []
        for (d, done), own in zip(told, links):
            text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in done[2]) if done else ""
            out.append((d, len(done[0]) if done else 0, len(done[1]) if done else 0, len(done[2]) if done else 0, sum(own.values()),
                        sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()),
                        hashlib.sha256(text.encode()).hexdigest() if text else "", done[3] if done else 0))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


def check(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:8])
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:8] for r in found] == [r[:8] for r in expected]
    assert all(f[8] == e[8] for f, e in zip(found, expected, strict=True) if e[8] is not None)


@pytest.mark.parametrize("heavy", [0, 300, align.HEAVY])
def test_documents_equal_plain_loops(spark, plain, heavy):
    docs = q.read(spark, FOLDER, "documents")
    check(align.align_corpus(docs, heavy=heavy).select(COLUMNS).collect(), plain.corpus([(r["doc_id"], r["text"]) for r in docs.collect()]))


ODD = [None, "", " ", "  two  spaces  ", "a", " leading", "trailing ", "tab\there\n\nlines\r\n", "<|endoftext|> <s> </s> <0x41> <unk>", "under▁score is lost",
       "x ▁ y", "nbsp in  side　wide   em", "café été naïve ü", "日本語 のテキスト 日本語", "\U0001f642 \U0001f643\U0001f642 x",
       "é ́x", "null\x00byte \x01 \x7f x", "it's I'll 'Tis we've DON'T", "1234 5 67,890.12 a1b2", "مرحبا بك", "!!! ??? ... --- ***",
       "\u0085 x \u0085", "１２ ﬁ Ω", "a" * 3000, " " * 700, "word " * 500, "中" * 900, "same words", "same words"]


def test_odd_texts(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (3, "repeated id")]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA + ", links string, ROW int, n int").repartition(3)
    check(align.align_corpus(docs, heavy=50).select(COLUMNS).collect(), plain.corpus(rows))


@pytest.mark.parametrize("store", [0, 40, 1000])
def test_small_blocks_and_long_texts(plain, monkeypatch, store):
    monkeypatch.setattr(align, "BLOCK", 300)
    monkeypatch.setattr(align, "EXPAND", 64)
    rows = [(i, t) for i, t in enumerate(ODD)]
    a, b = (c(d) for c, d in zip((align.ByteLevel, align.Pieces), align.load(align.TOKENIZERS)))
    import pyarrow as pa

    column = pa.array(ODD, pa.string())
    monkeypatch.setattr(align, "STORE", store)
    known = align.Store(a, b)
    got = [align.align_block([i for i, _ in rows[x:y]], column.slice(x, y - x), known, x, True) for x, y in align.blocks(column)]
    assert len(known.segments.strings) <= store
    assert len(got) > 5
    done = [r for batch in got for r in batch.to_pylist()]
    for r, e in zip(done, plain.corpus(rows), strict=True):
        assert (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*e[:5], e[7])
        assert sum(x["n"] for x in r["links"]) == r["n_links"]
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] if r["groups"] else r["n_a"] == 0


def test_long_document(spark, plain):
    text = " ".join(r["text"] for r in q.read(spark, FOLDER, "documents").collect())[:200_000]
    docs = spark.createDataFrame([(1, text), (2, text[1000:3000])], SCHEMA)
    row = next(r for r in align.align_corpus(docs).collect() if r["doc_id"] == 1)
    a, b, groups, _ = plain.document(text[:8_000])
    short = next(iter(align.align_texts(spark.createDataFrame([(1, text[:8_000])], SCHEMA), with_groups=True).collect()))
    assert short["groups"] == ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
    assert row["n_a"] == len(plain.a.encode(" " + text, add_special_tokens=False).ids)


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, y = rng.integers(0, 3, (13, 9)) * (rng.random((13, 9)) < 0.3), rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.3)
        made = [align.CSR.of(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (x, y)]
        dense = np.zeros((13, 7), int)
        for r, c, v in made[0].product(made[1].transpose()):
            dense[r, c] = v
        assert (dense == x @ y.T).all()


def test_vocabularies_divide_at_spaces():
    a, b = (c(d) for c, d in zip((align.ByteLevel, align.Pieces), align.load(align.TOKENIZERS)))
    assert a.divides and b.divides
    assert not any(re.search(rb"[!-~] ", t) for t in a.tokens)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one three"), (3, None)], SCHEMA)
    aligned = align.align_texts(docs).cache()
    counts = {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in align.pair_counts(aligned).collect()}
    assert sorted(n for n, _ in counts.values())[-1] == 2 and all(best for _, best in counts.values())
    assert aligned.select(F.size("links").alias("n")).orderBy("n").first()["n"] == 0

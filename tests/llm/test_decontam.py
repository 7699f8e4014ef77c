import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playbill.llm import decontam as d
from playbill.llm.words import PUNCTUATION


def distance(pattern, text):
    """Least edit distance of the pattern to any run of the text."""
    before = list(range(len(pattern) + 1))
    best = before[-1]
    for c in text:
        now = [0]
        for i, p in enumerate(pattern, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (p != c)))
        before = now
        best = min(best, now[-1])
    return best


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        m = rng.choice([1, 2, 5, 30, 63, 64, 65, 130])
        pattern, text = [rng.randrange(4) for _ in range(m)], [rng.randrange(4) for _ in range(rng.randrange(200))]
        masks = {}
        for i, p in enumerate(pattern):
            masks[p] = masks.get(p, 0) | 1 << i
        assert d.myers(masks, m, text)[0] == distance(pattern, text)


@pytest.mark.parametrize("m", [1, 7, 8, 9, 36, 60, 61])
def test_pieces_cover_the_item(m):
    k = d.budget(m)
    cut = d.pieces(m, k)
    assert len(cut) == k + 1 and sum(n for _, n in cut) == m and min(n for _, n in cut) >= 1
    assert all(a + n == b for (a, n), (b, _) in zip(cut, cut[1:]))


def words(text):
    return "".join(" " if c in PUNCTUATION.decode() or c in " \t\n\x0b\x0c\r" else c for c in (text or "")).translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")


def brute(docs, items):
    out = {}
    for i, text in docs:
        own = [w for w in words(text) if w]
        hits = []
        for j, item in items:
            p = [w for w in words(item) if w]
            if p and (n := distance(p, own)) <= d.budget(len(p)):
                hits.append((j, n))
        out[i] = sorted(hits)
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, say(rng.choice([3, 7, 8, 20, 40, 70]))) for i in range(25)]
    docs = []
    for i in range(120):
        text = say(rng.randrange(150))
        if i % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(max(1, len(part) // 4))):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = rng.choice([[], ["zz"], ["zz", "yy"]])
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (202, " ... "), (203, " ".join(items[3][1]).upper() + "!")]
    return docs, [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "?!")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_equals_brute_force(spark, documents, block_bytes):
    docs, items = fixture()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.find_items(documents(docs), table, block_bytes=block_bytes)
    got = {r["doc_id"]: sorted(zip(r["item_ids"], r["distances"])) for r in found.collect()}
    assert got == brute(docs, items)


def test_a_long_text_with_passages_at_both_ends(spark, documents):
    item = " ".join(f"u{i}" for i in range(30))
    text = item + " filler" * 400_000 + " " + item
    got = d.find_items(documents([(1, text), (1, text), (2, "filler " * 10)]), spark.createDataFrame([(5, item), (5, item)], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_ids"]) for r in got) == [(1, [5, 5]), (1, [5, 5]), (2, [])]


def test_decontaminate_keeps_columns(spark, documents):
    item = "one two three four five six seven eight nine ten"
    docs = documents([(1, f"x {item} y"), (2, "clean text"), (None, None)]).withColumns({"ITEM_IDS": F.lit(1), "distances": F.lit("x")})
    out = d.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {2, None}
    assert d.decontaminate(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 3


def test_run_hashes_are_those_of_texts():
    a, b = d.item_words(__import__("pyarrow").array(["a b c d", "x a b c"]))
    assert np.array_equal(d.run_hashes(a, 3)[:1], d.run_hashes(b, 3)[1:])

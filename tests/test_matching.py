"""Gram matching against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from playbill.operators.matching import match_few, match_pairs


def brute(tokens, keys):
    return {(t, k) for t in tokens for k in keys if t and k and (t in k or k in t)}


def pairs(spark, tokens, keys):
    found = []
    for match in (match_pairs, match_few):
        df = match(spark.createDataFrame([(t,) for t in tokens], "token string"),
                   spark.createDataFrame([(k,) for k in keys], "key string"))
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows))
        found.append(set(rows))
    assert found[0] == found[1]
    return found[0]


def test_random_vocabularies(spark):
    rng = random.Random(7)
    def word():
        return "".join(rng.choice("ab é") for _ in range(rng.randint(0, 7)))
    tokens, keys = {word() for _ in range(150)}, {word() for _ in range(120)}
    assert pairs(spark, tokens, keys) == brute(tokens, keys)


def test_shared_and_long_texts(spark):
    tokens = {"rock", "indie rock", "a", "the who", "x" * 5000 + "needle" + "y" * 5000, "né", "🎸 rock"}
    keys = {"rock", "o", "needle", "indie rock live", "the", "né", "🎸"}
    assert pairs(spark, tokens, keys) == brute(tokens, keys)


def test_one_gram_everywhere(spark):
    """A gram held by every text must not pair everything."""
    tokens = {f"the {i:03d}" for i in range(200)}
    keys = {f"the {i:03d} live" for i in range(0, 200, 2)}
    assert pairs(spark, tokens, keys) == brute(tokens, keys)


@settings(max_examples=8, deadline=None)
@given(tokens=st.sets(st.text("abc ", max_size=6), max_size=8), keys=st.sets(st.text("abc ", max_size=6), min_size=1, max_size=8))
def test_any_vocabulary(spark, tokens, keys):
    assert pairs(spark, tokens or {"a"}, keys) == brute(tokens or {"a"}, keys)

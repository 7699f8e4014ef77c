import math

import pytest
from pyspark.sql import functions as F

from playbill.llm import mixing


def rows_of(df):
    return sorted((r["doc_id"], r["copy"], r["n_copies"]) for r in df.collect())


def test_counts_are_poisson_with_the_target_rate(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, {"big": 1.0, "small": 1.0}).collect()}
    assert rates == {"big": pytest.approx(2 / 3), "small": pytest.approx(2.0)}
    mixed = mixing.mix_sources(docs, {"big": 1.0, "small": 1.0})
    counts = {(r["source"], r["n_copies"]): r["n"] for r in mixed.where("copy = 0").groupBy("source", "n_copies").agg(F.count("*").alias("n")).collect()}
    for source, size in (("big", 15_000), ("small", 5_000)):
        for k in range(1, 5):
            expected = size * math.exp(-rates[source]) * rates[source] ** k / math.factorial(k)
            assert abs(counts[source, k] - expected) < 5 * math.sqrt(expected)
    shares = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["big"] / 20_000 - 0.5) < 0.02 and abs(shares["small"] / 20_000 - 0.5) < 0.02


def test_large_rates_and_zero_weights(documents):
    docs = documents([(i, "x" * 100, "much") for i in range(100)] + [(1000, "x", "tiny"), (1001, "y", "none")])
    mixed = mixing.mix_sources(docs, {"much": 1.0, "tiny": 1.0, "none": 0.0})
    n = mixed.groupBy("source").count().collect()
    found = {r["source"]: r["count"] for r in n}
    assert set(found) == {"much", "tiny"} and abs(found["tiny"] - 5001) < 500


def test_edges_repeat_themselves(documents):
    docs = documents([(1, None, None), (None, "", "a"), (2, "one", "a"), (2, "one", "a"), (3, "two", "b")] + [(i, "text", "c") for i in range(10, 60)])
    clash = docs.withColumns({"Copy": F.lit("old"), "n_copies": F.lit("old")})
    mixed = mixing.mix_sources(clash, {"a": 3.0}, epochs=4)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies", "shuffle_key"]
    rows = [tuple(r) for r in mixed.collect()]
    again = [tuple(r) for r in mixing.mix_sources(clash, {"a": 3.0}, epochs=4).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))
    twos = [r for r in rows if r[0] == 2]
    assert len(twos) % 2 == 0 and len({r[6] for r in twos}) <= 1


def test_order_is_by_the_shuffle_key(spark, documents):
    mixed = mixing.mix_sources(documents([(i, "t", f"s{i % 3}") for i in range(500)]), {}, epochs=2)
    parts = mixed.select(F.spark_partition_id().alias("p"), "shuffle_key", "doc_id").collect()
    assert len({r["p"] for r in parts}) > 1
    for p in {r["p"] for r in parts}:
        keys = [r["shuffle_key"] for r in parts if r["p"] == p]
        assert keys == sorted(keys)


def test_bad_weights():
    with pytest.raises(ValueError):
        mixing.rates(None, {"a": -1.0})

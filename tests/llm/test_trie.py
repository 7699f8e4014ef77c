"""Tries against plain dictionaries, with containers that burst at different sizes."""

import hashlib
import random
import zlib

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from playbill.llm import queries as q
from playbill.llm import trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_sequences(rows):
    """Order of equal turn numbers as documented: by the id of the turn."""
    told = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            told.setdefault(conv, []).append(((turn is not None, turn or 0), tie, role, text))
    return {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in told.items()}


def plain_rebuilt(told):
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = told.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(told):
    members = {}
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = {p: [x for x in members if len(x) == len(p) + 1 and x[:-1] == p] for p in below}
        ends = ",".join(str(c) for c in sorted(c for c in who if len(told[c]) == len(path)))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids[path]),
                    sum(not k for k in kids.values()), sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, paths, most):
    nodes, ends = trie.prefix_trie(paths, most), trie.endings(paths)
    rows = nodes.join(ends, "node", "left").collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return sorted([(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_bytes"],
                    r["ends_sha256"] or hashlib.sha256(b"").hexdigest()) for r in rows], key=str)


def some_turns():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ü"]) * rng.randrange(1, 3)))
    for c in range(100, 130):  # many copies of one conversation, and a long one of the same beginning
        rows += [(c, t, "user", "copy") for t in range(4)]
    rows += [(200, t, "user", "copy") for t in range(300)]
    return rows


@pytest.mark.parametrize("most", [1, 2, 7, 10_000])
def test_equals_plain_trie(spark, most):
    rows = some_turns()
    paths = trie.sequences(spark.createDataFrame(rows, TURNS))
    expected = plain_trie(plain_sequences([r for r in rows if r[0] != 200 or r[1] < 12]))
    short = trie.sequences(spark.createDataFrame([r for r in rows if r[0] != 200 or r[1] < 12], TURNS))
    assert found(spark, short, most) == expected
    if most > 100:
        assert max(r[1] for r in found(spark, paths, most)) == 300


def test_copies_do_not_burst(spark):
    paths = trie.sequences(spark.createDataFrame([(c, t, "user", "same") for c in range(50) for t in range(3)], TURNS))
    assert [r[1:5] for r in found(spark, paths, 1)] == [(0, None, 50, 1), (1, 0, 50, 1), (2, 0, 50, 1), (3, 0, 50, 0)]


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "lost"),
            (2, None, "", ""), (3, 5, "user", "long " * 200_000), (-7, 1, "u", "user"), (-7, 1, "uu", "ser"), (10**12, 3, "é", "\x00")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", path string, NODE int")
    told = plain_sequences(rows)
    assert len(told[1]) == 4 and len(told[-7]) == 2
    for most in (1, 100):
        assert found(spark, trie.sequences(table), most) == plain_trie(told)


def test_an_empty_path_is_a_member_of_the_root(spark):
    paths = trie.sequences(spark.createDataFrame([(4, 0, "user", "x"), (5, 0, "user", "y")], TURNS))
    paths = paths.withColumn("path", F.when(F.col("conv_id") == 4, F.slice("path", 1, 0)).otherwise(F.col("path")))
    for most in (1, 9):
        assert found(spark, paths, most) == plain_trie({4: [], 5: [("user", "y")]})


def test_rebuilt(spark):
    rows = some_turns()
    expected = plain_rebuilt(plain_sequences(rows))
    ids = {(r, t): hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest() for turns in expected.values() for r, t in turns}
    done = q.rebuilt(trie.sequences(spark.createDataFrame(rows, TURNS))).collect()
    assert {r["conv_id"]: [t["id"] for t in r["path"]] for r in done} == {c: [ids[t] for t in turns] for c, turns in expected.items()}


def test_query_equals_sql_on_the_edges(spark, tmp_path):
    rows = [*some_turns(), (7, None, None, None), (7, 0, None, "z"), (None, 0, "user", "lost"), (-3, 0, "user", "minus")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    n, diff = compare(spark, con, str(tmp_path), q.QUERIES["op12_prefix_trie"], q.ORACLES["op12_prefix_trie"])
    assert n > 0 and diff == []


def test_pieces_and_digest_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    paths = spark.range(1000).select(F.col("id").alias("conv_id"), F.array(F.struct(F.md5(F.lit("x")).alias("id"), F.lit(1).cast("bigint").alias("bytes"))).alias("path"))
    (row,) = trie.endings(paths).collect()
    assert (row["n_ends"], row["ends_sha256"]) == (1000, hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest())

import random

from playbill.llm.components import components
from playbill.llm.storage import Workspace


def least(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def found(spark, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    return {r["id"]: r["component"] for r in components(df, Workspace(spark)).collect()}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(3)
    path = list(range(60))
    rng.shuffle(path)
    graphs = [
        [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        list(zip(path, path[1:])),
        [(50, i) for i in range(50)] + [(7, 7), (50, 3), (50, 3)],
    ]
    for edges in graphs:
        assert found(spark, edges) == {k: v for k, v in least(edges).items() if k != v}


def test_no_edges(spark):
    assert found(spark, []) == {} and found(spark, [(1, 1)]) == {}

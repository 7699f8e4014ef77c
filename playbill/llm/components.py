"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.storage import Workspace


def large_star(edges: DataFrame, space: Workspace) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(space.keep(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, space: Workspace) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = space.keep(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(id, component): the smallest id that each node of an edge (u, v) can reach, other than nodes that are it.

    Loops and repeated edges are allowed. Both stars combine map-side; the least neighbours are stored,
    so the join on the node reads both sides from a shuffle and can split a hub's rows. No
    neighbourhood is collected. Each round is written to the shared folder. The rounds end when the edges stay as they are, which is a
    star around each smallest node.
    """
    now = space.keep(edges.where("u != v").select("u", "v"), "edges")
    seen = None
    while True:
        following = space.keep(small_star(space.keep(large_star(now, space), "large"), space), "stars")
        mark = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return following.select(F.col("u").alias("id"), F.col("v").alias("component"))
        now, seen = following, tuple(mark)

"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture. Its repetition rate is the share
times the mixture's size over the source's own size; every document is repeated
a Poisson number of times with that mean. The number comes from inverting the
distribution at a uniform value hashed from seed and doc_id, so a rerun, or a
task that runs again after a lost executor, draws the same mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.storage import Workspace, clean_columns

ADDED = ["copy", "n_copies", "shuffle_key"]


def uniform(seed: int, *parts: Column) -> Column:
    """A value in [0, 1) from 52 bits of a hash of seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, size, rate, cdf) of every source, one row each.

    Sizes are characters, counted over all texts; a null or empty text counts as one
    character, so that no source has size zero. ``weights`` are relative; a source that
    it does not name, null included, has ``default_weight``. The mixture is ``epochs``
    times the corpus. ``cdf`` holds the distribution function from 0 up to where it is
    1 in double precision.
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()) or epochs <= 0:
        raise ValueError("weights must not be negative, and epochs must be positive")
    sizes = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(1)), F.lit(1))).cast("bigint").alias("size"))
    weight = F.lit(float(default_weight))
    for source, value in weights.items():
        weight = F.when(F.col("source") == source, float(value)).otherwise(weight)
    sizes = Workspace(docs.sparkSession).keep(sizes.withColumn("weight", weight), "sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    scale = float(epochs) * (total["size"] or 0) / total["weight"] if total["weight"] else 0.0
    rate = sizes.select("source", "n_docs", "size", (F.col("weight") / F.col("size") * F.lit(scale)).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    step = F.struct(
        F.lit(0.0).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        log_p = F.when(k == 0, -F.col("rate")).otherwise(acc["log_p"] + F.log("rate") - F.log(F.greatest(k, F.lit(1)).cast("double")))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    table = F.aggregate(F.sequence(F.lit(0), last), step, add)["cdf"]
    return rate.withColumn("cdf", F.when(F.col("rate") > 0, table).otherwise(F.array(F.lit(1.0))))


def mix_sources(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0,
                seed: int = 17) -> DataFrame:
    """The mixture: every document as often as drawn, in a random order over all partitions.

    Adds ``copy`` (0, 1, ...), ``n_copies`` and ``shuffle_key``; input columns of those
    names are dropped. Partitions are dealt by ``shuffle_key``, a hash of seed, doc_id and
    copy, and sorted by it. Rows that share a doc_id (null included) are drawn alike. A
    source whose weight is 0 vanishes; an empty table gives an empty mixture. The rates are
    one row per source: they are broadcast only if measured small, else joined with hot
    sources split.
    """
    kept = clean_columns(docs, ADDED)
    base = docs.select(*kept)
    table = rates(base, weights, default_weight, epochs).select(F.col("source").alias("_source"), F.col("cdf").alias("_cdf"))
    drawn = base.join(table, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "n_copies", F.size(F.filter("_cdf", lambda c: c <= uniform(seed, F.col("doc_id")))).cast("bigint"))
    copies = drawn.where("n_copies > 0").select(
        *kept, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_copies") - 1)).alias("copy"), "n_copies")
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")

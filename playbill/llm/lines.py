"""Line dedup over an index that can grow, shrink and be undone.

The index is a set of shards. Each shard has an exact reference table, one row
for each line key and document with the number of times that document was
inserted less the times it was deleted, and a cuckoo filter over its frequent
keys. Inserting documents adds references, deleting them takes the same
references back; a key whose last reference goes leaves the filter. Looking up
a line asks the filter of its shard first; only the few lines that pass reach the
exact table, which decides. So results never depend on the filter's errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions.text import let
from playbill.llm.cuckoo import CuckooFilter
from playbill.llm.storage import Workspace, clean_columns

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, SHARD_KEYS = 40, 5, 20_000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(c: str = "text") -> Column:
    return F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), CAPITALS, CAPITALS.lower())


def identity(key: Column) -> Column:
    """128 bits of two independent hashes stand for the key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, doc_id): one row for each long line key of a document, however often the document holds it."""
    keys = F.filter(F.transform(lines_of(), key_of), lambda k: F.char_length(k) >= min_chars)
    return docs.select("doc_id", F.inline(F.array_distinct(F.transform(keys, identity))))


def insertions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """References to add; append them to the index's log. Deletions are the same rows with -1."""
    return references(docs, min_chars).withColumn("n", F.lit(1))


def deletions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return references(docs, min_chars).withColumn("n", F.lit(-1))


def counts(log: DataFrame) -> DataFrame:
    """(a, b, n_docs, keeper) from a log of references: documents that still hold the key, and the largest of them.

    Both steps combine map-side, so a line that a third of all documents hold reaches its
    reducers as a row for each task. Rows with one doc_id are one document.
    """
    held = log.groupBy("a", "b", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    return held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def shard_of(n: int) -> Column:
    return F.pmod(F.col("b"), F.lit(n)).cast("int")


def _filters(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": rows["shard"][:1], "filter": [CuckooFilter.of(rows["a"].to_numpy(np.int64).view(np.uint64)).dump()]})


def filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): the cuckoo filter of each shard's keys; the number of shards follows the keys, so a shard is bounded."""
    keys = frequent.select("a", shard_of(shards).alias("shard")).distinct()
    return keys.groupBy("shard").applyInPandas(_filters, "shard int, filter binary")


def apply_deletions(stored: DataFrame, gone: DataFrame, shards: int) -> DataFrame:
    """Filters after keys of ``gone`` (a, b) left the exact table: their fingerprints are deleted in place."""
    keys = gone.select("a", shard_of(shards).alias("shard")).distinct()

    def delete(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left
        made = CuckooFilter.load(left["filter"].iloc[0])
        if len(right):
            made.delete(right["a"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": left["shard"], "filter": [made.dump()]})

    return stored.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(delete, "shard int, filter binary")


def probe(lines: DataFrame, stored: DataFrame, shards: int, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``lines`` (doc_id, keys: array of (a, b, at)) as (doc_id, a, b, at) that a filter lets through.

    Filters of together at most ``most_bytes`` are broadcast and asked in the scan's own stage. Larger
    ones are joined to the rows by shard.
    """
    size = stored.agg(F.sum(F.length("filter")).alias("n")).first()["n"] or 0
    if size <= most_bytes:
        known = {r["shard"]: r["filter"] for r in stored.collect()}
        sent = lines.sparkSession.sparkContext.broadcast(known)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = {s: CuckooFilter.load(f) for s, f in sent.value.items()}
            for batch in batches:
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                passed, shard = np.zeros(len(a), bool), b % shards
                for s in np.unique(shard):
                    if s in ready:
                        rows = np.flatnonzero(shard == s)
                        passed[rows] = ready[s].contains(a[rows].view(np.uint64))
                yield batch.filter(pa.array(passed))

        return lines.mapInArrow(ask, lines.schema)

    columns = lines.columns

    def ask_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, shard = batch.column("a").to_numpy(), batch.column("shard").to_numpy()
            stored_filters, passed = batch.column("filter"), np.zeros(len(a), bool)
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                passed[rows] = CuckooFilter.load(stored_filters[int(rows[0])].as_py()).contains(a[rows].view(np.uint64))
            yield batch.select(columns).filter(pa.array(passed))

    joined = lines.withColumn("shard", shard_of(shards)).join(stored, "shard")
    return joined.mapInArrow(ask_joined, lines.schema)


def dedup_lines(docs: DataFrame, log: DataFrame | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Documents without their frequent lines: adds ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without white space at both ends and with small letters A-Z. Keys
    of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all
    their lines, except in the largest doc_id holding them, which keeps them all. ``log`` is
    the index to judge against; without one, the documents themselves. A null or empty text
    is one empty line. Rows sharing a doc_id are one document to the counts. Rows with a null
    doc_id are one document that never is the keeper if another holds the line. Input
    columns named like an added one are dropped. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    log = space.keep(insertions(docs, min_chars) if log is None else log, "references")
    frequent = space.keep(counts(log).where(F.col("n_docs") >= min_docs).drop("n_docs"), "frequent")
    shards = max(1, -(-frequent.count() // shard_keys))
    stored = space.keep(filters(frequent, shards), "filters")
    # Long lines only meet the filter; what passes is a key, a place and no text.
    held = docs.select("doc_id", F.xxhash64("text").alias("row"), F.inline(F.filter(
        F.transform(lines_of(), lambda line, i: let(key_of(line), lambda k: F.when(
            F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"), i.alias("at"))))),
        lambda x: x.isNotNull())))
    passed = probe(held, stored, shards)
    dropped = passed.join(frequent, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = dropped.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("at").alias("_drop"))
    kept = clean_columns(docs, ["n_lines", "n_dropped", "kept_text"])
    base = docs.select(*kept, F.xxhash64("text").alias("_hash"))
    joined = base.join(places, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_row")), "left")
    staged = joined.select(*kept, lines_of().alias("_lines"), F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    return staged.select(
        *kept, F.size("_lines").cast("bigint").alias("n_lines"), F.size("_drop").cast("bigint").alias("n_dropped"),
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n").alias("kept_text"))


class LineIndex:
    """The stored log of references: ``insert`` and ``delete`` append, ``compact`` adds up what belongs together.

    Deleting what was inserted restores every count and keeper, in whatever order the batches came.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS) -> None:
        self.spark, self.path, self.min_chars = spark, path, min_chars

    def insert(self, docs: DataFrame) -> None:
        insertions(docs, self.min_chars).write.mode("append").parquet(self.path)

    def delete(self, docs: DataFrame) -> None:
        deletions(docs, self.min_chars).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        return self.spark.read.schema("a bigint, b bigint, doc_id bigint, n int").parquet(self.path)

    def compact(self, path: str) -> LineIndex:
        """The same index with one row a reference, written to another folder; readers of the old one go on."""
        self.log().groupBy("a", "b", "doc_id").agg(F.sum("n").cast("int").alias("n")).where("n != 0").write.parquet(path)
        return LineIndex(self.spark, path, self.min_chars)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        return counts(self.log()).where(F.col("n_docs") >= min_docs)

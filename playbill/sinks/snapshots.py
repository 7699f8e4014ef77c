"""The stored listings table: segments that are merged when read, and a commit list.

A batch is only appended: merged within itself, it becomes a segment of its own.

    <root>/segments/<name>/event_date=<day>/*.parquet
    <root>/commits/*.parquet             (name, first_batch, last_batch, level)

Commit rows are written after the segment they name, so a batch that dies half-way leaves
nothing readers see, and each attempt writes under a new name. A batch that is committed already
is skipped. FANOUT segments of a level are merged into one of the next, so a row is rewritten
once a level and readers merge few segments. ``clean`` removes what a merge replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from playbill.operators.ingest import upsert
from playbill.schema import KEPT, MUTABLE
from playbill.session import remove

COMMIT = "name string, first_batch long, last_batch long, level int"
COLUMNS = ["dedupe_key", *MUTABLE, *KEPT, "updated_at"]
FANOUT = 8


def _commits(spark: SparkSession, root: str) -> list[Row]:
    """All commit rows. They are few: merges and ``clean`` keep them to some for each level."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/commits").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def live(commits: list[Row], before: int | None = None) -> list[Row]:
    """The segments that make up the table, oldest first: those no larger one covers.

    With ``before``, the table as it stood before that batch.
    """
    known = [c for c in commits if before is None or c.last_batch < before]
    covered = lambda c: any(
        o.level > c.level and o.first_batch <= c.first_batch and c.last_batch <= o.last_batch for o in known)
    return sorted((c for c in known if not covered(c)), key=lambda c: c.first_batch)


def _merged(spark: SparkSession, root: str, segments: list[Row]) -> DataFrame:
    """The rows of several segments, one a key: fields of the last that has it, user state of the first."""
    parts = [spark.read.parquet(f"{root}/segments/{s.name}").select(*COLUMNS, F.lit(i).alias("_place")) for i, s in enumerate(segments)]
    if len(parts) == 1:
        return parts[0].select(*COLUMNS)
    rows = reduce(DataFrame.unionByName, parts)
    # The key holds the day; grouping by both lets filters on the day pass below the merge.
    fields = [c for c in MUTABLE if c != "event_date"]
    merged = rows.groupBy("dedupe_key", "event_date").agg(
        F.max_by(F.struct(*fields), "_place").alias("last"), F.min_by(F.struct(*KEPT), "_place").alias("first"),
        F.max("updated_at").alias("updated_at"))
    return merged.select("dedupe_key", "event_date", "last.*", "first.*", "updated_at").select(*COLUMNS)


def current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The table as of the last commit, or before a batch; None if there is no commit.

    ``event_date`` is a partition column, so filters on it prune files in every segment.
    """
    segments = live(_commits(spark, root), before)
    return _merged(spark, root, segments) if segments else None


def _add(spark: SparkSession, root: str, rows: DataFrame, first: int, last: int, level: int) -> None:
    """Write a segment, then its commit row. Rebalancing by day gives files of even size: small days share a
    task, a day that holds much of the batch is split over several."""
    name = f"{first}-{last}-{uuid.uuid4().hex}"
    rows.select(*COLUMNS).hint("rebalance", "event_date").write.partitionBy("event_date").parquet(f"{root}/segments/{name}")
    spark.createDataFrame([(name, first, last, level)], COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def write_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, batch_time: Column, fanout: int = FANOUT) -> None:
    """Append a normalised batch and commit it; a batch that is committed already changes nothing.

    The stored table is not read, unless enough segments have gathered to be merged.
    """
    commits = _commits(spark, root)
    if any(c.first_batch <= batch_id <= c.last_batch for c in commits):
        return
    if batch.isEmpty():
        return
    _add(spark, root, upsert(None, batch, batch_time), batch_id, batch_id, 0)
    compact(spark, root, fanout)


def compact(spark: SparkSession, root: str, fanout: int = FANOUT) -> None:
    """Merge neighbouring segments of one level, ``fanout`` at a time, until no level has so many."""
    while True:
        segments = live(_commits(spark, root))
        for level in sorted({s.level for s in segments}):
            same = [s for s in segments if s.level == level]
            if len(same) >= fanout:
                chosen = same[:fanout]
                _add(spark, root, _merged(spark, root, chosen), chosen[0].first_batch, chosen[-1].last_batch, level + 1)
                break
        else:
            return


def clean(spark: SparkSession, root: str) -> None:
    """Remove replaced segments and shorten the commit list. For times when no reader holds an older table.

    The short list is appended to the commits first; only then do the older files go, one at a time, and the replaced
    segments after them. Readers take distinct rows of all files, so the table is whole after every step, and
    a ``clean`` that died half-way is finished by the next.
    """
    commits = _commits(spark, root)
    keep = live(commits)
    older = spark.read.schema(COMMIT).parquet(f"{root}/commits").inputFiles() if keep else []
    if len(older) < 2 and len(keep) == len(commits):
        return
    if keep:
        spark.createDataFrame([tuple(c) for c in keep], COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    for file in older:
        remove(spark, file)
    named = {c.name for c in keep}
    for name in _segments(spark, root):
        if name not in named:
            remove(spark, f"{root}/segments/{name}")


def _segments(spark: SparkSession, root: str) -> list[str]:
    """Names of all segment folders, those of batches that died included."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{root}/segments")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

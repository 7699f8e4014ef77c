"""The batch operators as Structured Streaming jobs.

Every job runs what is available and stops, keeps its checkpoint in the shared
folder, and leaves results as Parquet. A replayed micro-batch overwrites its own
output, so results survive restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.operators.feedback import signal_rows
from playbill.operators.ingest import normalize, upsert_counts
from playbill.session import work_folder
from playbill.sinks import snapshots


def new_folder(spark: SparkSession, job: str) -> str:
    return work_folder(spark, job)


def drain(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over everything available, handing each micro-batch to ``each``."""
    (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).foreachBatch(each).start().awaitTermination())


def appended(stream: DataFrame, job: str) -> DataFrame:
    """All rows a stream in append mode emits."""
    spark, schema = stream.sparkSession, stream.schema
    folder = new_folder(spark, job)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    drain(stream, folder, keep)
    return spark.read.schema(schema).parquet(f"{folder}/out").select(*schema.names)


def latest_per_key(stream: DataFrame, keys: list[str], job: str, mode: str) -> DataFrame:
    """Final rows of a streaming aggregate: the newest emitted row of each key."""
    spark = stream.sparkSession
    folder = new_folder(spark, job)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    drain(stream, folder, keep, mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("last")).select(*keys, "last.*")


def stream_upsert(raw: DataFrame, root: str, batch_time: Callable[[int], Column]) -> None:
    """Merge a stream of raw records into the stored table, batch by batch."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        clean = normalize(batch).persist()
        try:
            snapshots.write_batch(batch.sparkSession, root, clean, batch_id, batch_time(batch_id))
        finally:
            clean.unpersist()

    drain(raw, root, merge)


def stream_run_totals(raw: DataFrame, root: str, batch_time: Callable[[int], Column], source: str = "stream") -> None:
    """As ``stream_upsert``, and a run log row per batch: the log's columns, and found, added, updated and invalid."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clean = normalize(batch).persist()
        try:
            earlier = snapshots.current(spark, root, before=batch_id)
            if earlier is not None:
                # The key holds the day, so only the batch's days can already hold its keys; the days prune the files read.
                earlier = earlier.join(clean.select("event_date").distinct(), "event_date", "left_semi")
            counts = upsert_counts(earlier, batch, clean)
            run = counts.select(
                F.lit(batch_id).cast("long").alias("run_id"), F.lit(source).alias("source"), F.lit(source).alias("source_name"),
                F.lit("ok").alias("status"), F.col("found").alias("events_found"), F.col("added").alias("events_added"),
                F.lit(None).cast("string").alias("error_msg"), batch_time(batch_id).alias("run_at"), "found", "added", "updated", "invalid")
            run.write.mode("overwrite").parquet(f"{root}/runs/batch_id={batch_id}")
            snapshots.write_batch(spark, root, clean, batch_id, batch_time(batch_id))
        finally:
            clean.unpersist()

    drain(raw, root, merge)


def first_seen(keyed: DataFrame, event_time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark: a signal that a key is new.

    First-wins, so it never replaces the merge, where the last write wins.
    """
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def signal_totals(marks: DataFrame) -> DataFrame:
    """Running signal count and last time per tag."""
    return signal_rows(marks).groupBy("tag").agg(
        F.count("*").cast("double").alias("signal_count"), F.max("ts").alias("last_signal"))


def interest_signals(marks: DataFrame, listings: DataFrame, delay: str, within: str) -> DataFrame:
    """(tag, ts) rows of a stream of marks (id, ts) that meets a stream of listings (id, genre_tags, artist, ts).

    Either may come first, up to ``within`` apart by their own times; rows later than ``delay`` are lost. Both bounds
    together tell how long a row is held, so the state stays bounded. Repeated marks count again; a null id meets nothing.
    """
    marked = marks.select("id", F.col("ts").cast("timestamp").alias("marked_at")).withWatermark("marked_at", delay)
    listed = listings.select(
        F.col("id").alias("listing_id"), "genre_tags", "artist", F.col("ts").cast("timestamp").alias("listed_at")).withWatermark("listed_at", delay)
    near = F.expr(f"marked_at >= listed_at - interval {within} AND marked_at <= listed_at + interval {within}")
    met = marked.join(listed, (F.col("id") == F.col("listing_id")) & near)
    return signal_rows(met.select("genre_tags", "artist", F.col("marked_at").cast("timestamp_ntz").alias("ts")))


def day_counts(listings: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Listings per calendar day as tumbling one-day windows."""
    windowed = listings.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day"))
    return windowed.agg(F.count("*").alias("n")).select(
        F.col("window.start").cast("date").alias("event_date"), "n")


def latest_runs(log: DataFrame) -> DataFrame:
    """Last log row per source, as a running aggregate."""
    rest = [c for c in log.columns if c != "source_name"]
    return (log.groupBy("source_name").agg(F.max_by(F.struct(*rest), "run_id").alias("last"))
            .select("source_name", "last.*"))

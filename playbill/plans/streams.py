"""Streaming jobs over the events table; each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.plans import tables as tb
from playbill.plans.core import FIRST_TIME
from playbill.plans.preference import LATEST, LOG, SIGNAL_SQL, _log_text, _signal_text
from playbill.plans.registry import query
from playbill.plans.tables import LISTINGS, NORMAL, SIGNALS
from playbill.operators.feedback import record_signals
from playbill.operators.ingest import normalize
from playbill.schema import MUTABLE
from playbill.session import ROWS_A_FILE
from playbill.sinks import logs, snapshots
from playbill.streaming import jobs

KEPT_COLUMNS = f"dedupe_key, {', '.join(MUTABLE)}, id"
MERGED = f"""WITH {NORMAL}, ranked AS (SELECT *,
    row_number() OVER (PARTITION BY dedupe_key ORDER BY precedence DESC, seq DESC) AS newest,
    first_value(seq) OVER (PARTITION BY dedupe_key ORDER BY precedence, seq) AS id FROM normal)"""


def _landings(spark, d, root):
    """The events land in four turns by event_id; after each, a stream over the folder. A turn is one micro-batch of a job
    that runs then, read from as many files as its rows fill."""
    events = tb.read(spark, d, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    bounds = [low - (low - high - 1) * i // 4 for i in range(5)]
    for i in range(4):
        number = F.col("event_id")
        turn = events.where((number >= bounds[i]) & (number < bounds[i + 1]))
        turn.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{root}/landed/part={i}")
        yield _landed_stream(spark, root)


def _landed_stream(spark, root, **options):
    return (spark.readStream.schema(tb.SCHEMAS["events"]).options(**options).option("recursiveFileLookup", True)
            .parquet(f"{root}/landed"))


def _stamp(batch_id):
    return tb.ntz(FIRST_TIME)


@query("silver_write", f"{MERGED} SELECT {KEPT_COLUMNS} FROM ranked WHERE newest = 1")
def _(spark, d):
    """Written as a table, then read back."""
    root = jobs.new_folder(spark, "silver")
    snapshots.write_batch(spark, root, normalize(tb.raw_listings(spark, d)), 0, _stamp(0))
    return snapshots.current(spark, root).select("dedupe_key", *MUTABLE, "id")


@query("run_log_written", f"WITH {tb.RUN_LOG} SELECT source_name, count(*) AS n, CAST(sum(events_added) AS BIGINT) AS added FROM run_log GROUP BY source_name")
def _(spark, d):
    """Appended in two runs, then read back."""
    path = jobs.new_folder(spark, "log")
    log = tb.run_log(spark, d)
    logs.append_runs(log.where("status = 'ok'"), path)
    logs.append_runs(log.where("status <> 'ok'"), path)
    return spark.read.parquet(path).groupBy("source_name").agg(
        F.count("*").alias("n"), F.sum("events_added").alias("added"))


@query("stream_upsert", f"""WITH {NORMAL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY part DESC, seq DESC) AS newest,
    first_value(seq) OVER (PARTITION BY dedupe_key ORDER BY part, seq) AS id
    FROM (SELECT *, (seq - (SELECT min(event_id) FROM events)) * 4 // (SELECT max(event_id) - min(event_id) + 1 FROM events) AS part FROM normal))
  SELECT {KEPT_COLUMNS} FROM ranked WHERE newest = 1""")
def _(spark, d):
    """The events arrive in several turns, one a micro-batch; the merge must not depend on it."""
    root = jobs.new_folder(spark, "upsert")
    for landed in _landings(spark, d, root):
        jobs.stream_upsert(tb.raw_listings(spark, d, landed).withColumn("precedence", F.lit(0)), root, _stamp)
    return snapshots.current(spark, root).select("dedupe_key", *MUTABLE, "id")


@query("stream_run_totals", f"""WITH {NORMAL}, t AS (SELECT (SELECT count(*) FROM raw) AS found, (SELECT count(*) FROM normal) AS valid,
    (SELECT count(DISTINCT dedupe_key) FROM normal) AS added)
  SELECT 'feed' AS source, 'ok' AS status, found, added, valid - added AS updated, found - valid AS invalid FROM t""")
def _(spark, d):
    """A turn a micro-batch; the totals of the runs are those of one batch."""
    root = jobs.new_folder(spark, "totals")
    for landed in _landings(spark, d, root):
        jobs.stream_run_totals(tb.raw_listings(spark, d, landed), root, _stamp, "feed")
    runs = spark.read.parquet(f"{root}/runs")
    return runs.groupBy("source", "status").agg(*[F.sum(c).alias(c) for c in ("found", "added", "updated", "invalid")])


@query("stream_dedupe", f"WITH {tb.ACTIONS} SELECT DISTINCT dedupe_key FROM actions")
def _(spark, d):
    """The watermark outlasts the data here, so every key is seen exactly once."""
    keyed = tb.actions(spark, d, tb.event_stream(spark, d)).select("dedupe_key", F.col("ts").cast("timestamp").alias("at"))
    folder = jobs.new_folder(spark, "dedupe")

    def keep(batch, batch_id):
        batch.select("dedupe_key").write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    jobs.drain(jobs.first_seen(keyed, "at", "60 days"), folder, keep)
    return spark.read.parquet(f"{folder}/out").select("dedupe_key")


@query("stream_signals", f"WITH {SIGNALS} SELECT {SIGNAL_SQL} FROM signals")
def _(spark, d):
    marks = tb.marks(spark, d, tb.event_stream(spark, d))
    return _signal_text(jobs.latest_per_key(jobs.signal_totals(marks), ["tag"], "signals", "update"))


@query("stream_interest_signals", f"""WITH {LISTINGS}, met AS (
    SELECT l.genre_tags, l.artist, e.ts FROM events e JOIN listings l ON l.id = e.event_id - e.event_id % 3 WHERE e.event_type = 'purchase'),
  signals AS (SELECT tag, CAST(count(*) AS DOUBLE) AS signal_count, max(ts) AS last_signal FROM (
    SELECT unnest(string_split(genre_tags, ', ')) AS tag, ts FROM met
    UNION ALL SELECT lower(artist), ts FROM met WHERE artist <> '') GROUP BY tag)
  SELECT {SIGNAL_SQL} FROM signals""")
def _(spark, d):
    """Purchases mark the listing of an earlier event. Listings come in four micro-batches, marks in one; neither waits for the other."""
    root = jobs.new_folder(spark, "landed")
    for _ in _landings(spark, d, root):
        pass
    files = len(spark.read.schema(tb.SCHEMAS["events"]).option("recursiveFileLookup", True).parquet(f"{root}/landed").inputFiles())
    landed = _landed_stream(spark, root, maxFilesPerTrigger=-(-files // 4))
    found = tb.event_stream(spark, d).where("event_type = 'purchase'")
    marks = found.select((F.col("event_id") - F.col("event_id") % 3).alias("id"), "ts")
    met = jobs.interest_signals(marks, tb.listings(spark, d, landed), "60 days", "60 days")
    return _signal_text(record_signals(jobs.appended(met, "interest")))


@query("stream_day_counts", f"WITH {LISTINGS} SELECT event_date, count(*) AS n FROM listings WHERE NOT hidden GROUP BY event_date")
def _(spark, d):
    shown = tb.listings(spark, d, tb.event_stream(spark, d)).where(~F.col("hidden")).select(F.col("ts").cast("timestamp").alias("at"))
    return jobs.latest_per_key(jobs.day_counts(shown, "at", "1 day"), ["event_date"], "days", "complete")


@query("stream_latest_run", f"WITH {LATEST} SELECT {LOG} FROM latest")
def _(spark, d):
    log = tb.run_log(spark, d, tb.event_stream(spark, d))
    return _log_text(jobs.latest_per_key(jobs.latest_runs(log), ["source_name"], "latest", "update"))



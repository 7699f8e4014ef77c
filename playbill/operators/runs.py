"""Ingest run log and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf, moment
from playbill.functions.text import truthy
from playbill.operators.filters import at_most

LOG_DEFAULT, LOG_MAX = 50, 200


def log_rows(runs: DataFrame) -> DataFrame:
    """Run summaries with the defaults of the log table."""
    return runs.select(
        "run_id", "source", F.coalesce(truthy("source_name"), "source").alias("source_name"), "status",
        F.coalesce("events_found", F.lit(0)).alias("events_found"),
        F.coalesce("events_added", F.lit(0)).alias("events_added"),
        truthy("error_msg").alias("error_msg"), "run_at")


def latest_run_per_source(log: DataFrame) -> DataFrame:
    """Last log row of each source.

    The largest run of each source is a hash aggregate over two narrow columns; then only those
    rows are fetched, so no task sorts its share of the log.
    """
    last = log.groupBy("source_name").agg(F.max("run_id").alias("last_run")).select(
        F.col("source_name").alias("last_source"), "last_run")
    newest = (F.col("run_id") == F.col("last_run")) & F.col("source_name").eqNullSafe(F.col("last_source"))
    return log.join(last, newest, "left_semi").orderBy(F.desc("run_at"))


def recent_logs(log: DataFrame, limit: int | None = None, most: int = LOG_MAX) -> DataFrame:
    """The last runs. Asking for more than ``most`` gives ``most``, with a warning."""
    return log.orderBy(F.desc("run_id")).limit(at_most(limit or LOG_DEFAULT, most))


def status_summary(listings: DataFrame, log: DataFrame) -> DataFrame:
    """Listings in total, hidden ones included, and the time of the last run."""
    total = listings.agg(F.count("*").alias("total")).select("total", F.lit(None).cast("timestamp_ntz").alias("last_run_at"))
    latest = latest_run_per_source(log).agg(F.max("run_at").cast("timestamp_ntz").alias("last_run_at"))
    both = total.unionByName(latest.select(F.lit(None).cast("long").alias("total"), "last_run_at"))
    return both.agg(F.max("total").alias("total"), F.max("last_run_at").alias("last_run_at"))


def run_totals(log: DataFrame) -> DataFrame:
    """Added listings and errors per adapter; ``is_total`` marks the grand total, which a null adapter is not."""
    return log.rollup("source").agg(
        F.grouping("source").cast("boolean").alias("is_total"),
        F.sum("events_added").cast("long").alias("added"),
        F.count_if(F.col("status") == "error").alias("errors"))


def health_flag(log: DataFrame) -> DataFrame:
    """'error' if any latest run failed, 'ok' if there is any run, else ''."""
    return latest_run_per_source(log).agg(
        F.when(F.count_if(F.col("status") == "error") > 0, "error")
        .when(F.count("*") > 0, "ok").otherwise("").alias("flag"))


def relative_time(then: Column, as_of: AsOf) -> Column:
    """'never', 'just now', 'Nm ago', 'Nh ago' or 'Nd ago', rounding at each step."""
    micros = F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    minutes = F.floor(micros / 60e6 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return (F.when(then.isNull(), "never").when(minutes < 1, "just now")
            .when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h"))
            .otherwise(ago(days, "d")))


def extraction_health(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Per registered source: items matched, usable ones, and the verdict.

    ``items`` has (source_name, reason), as ``item_report`` gives them: reason is null for a record, and
    page errors begin with "unreadable". ``cut`` counts items over a cap, ``failed`` unreadable pages. A
    registered source without items still reports, and so does a source that only its items know.
    """
    unread = F.coalesce(F.col("reason").startswith("unreadable"), F.lit(False))
    per_source = items.groupBy("source_name").agg(
        F.count_if(~unread).alias("matched"), F.count_if(F.col("reason").isNull()).alias("usable"),
        F.count_if(F.col("reason") == "over the cap").alias("cut"), F.count_if(unread).alias("failed"))
    numbers = ["matched", "usable", "cut", "failed"]
    counted = registry.select("source_name").join(per_source, "source_name", "full").select(
        "source_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    return counted.withColumn("verdict", F.when(F.col("matched") == 0, "no items matched")
                              .when(F.col("usable") == 0, F.concat_ws(" ", F.lit("matched"), F.col("matched"), F.lit("but none usable")))
                              .otherwise("ok")).withColumn(
        "status", F.when(F.col("usable") > 0, "ok").otherwise("error"))


def isolate_failures(documents: DataFrame, records: DataFrame, rejects: DataFrame) -> DataFrame:
    """One log row per landed document: unreadable ones become error rows and never stop the others.

    ``documents`` has (run_id, source_name); ``records`` a row per record read, by run_id; ``rejects``
    (run_id, reason) what a reader gave back. A reason that begins with "unreadable" is the whole document's.
    """
    found = records.groupBy("run_id").agg(F.count("*").alias("n"))
    bad = rejects.groupBy("run_id").agg(
        F.count("*").alias("rejected"), F.min(F.when(F.col("reason").startswith("unreadable"), F.col("reason"))).alias("error_msg"))
    broken = F.col("error_msg").isNotNull()
    return documents.join(found, "run_id", "left").join(bad, "run_id", "left").select(
        "run_id", "source_name", F.when(broken, "error").otherwise("ok").alias("status"),
        F.when(broken, 0).otherwise(F.coalesce("n", F.lit(0))).alias("events_found"),
        F.when(broken, 0).otherwise(F.coalesce("rejected", F.lit(0))).alias("rejected"), "error_msg")

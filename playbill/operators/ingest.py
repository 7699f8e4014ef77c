"""Normalise, key, merge and count listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.functions.text import category_clamp, dedupe_key, strip, truthy
from playbill.functions.urls import url_guard
from playbill.schema import KEPT, MUTABLE

# Adapters in the order they run; a later one overwrites.
ADAPTER_ORDER = ["ticketmaster", "eventbrite", "bandsintown", "rss", "scraper"]


def is_valid() -> Column:
    """Title, date and venue present, and the date is a real ``YYYY-MM-DD`` day.

    Stricter than a shape test in two ways: impossible days and all-blank
    titles or venues are rejected, since the table stores a DATE and a key.
    """
    ten = F.substring("date", 1, 10)
    present = (F.coalesce(strip("title"), F.lit("")) != "") & (F.coalesce(strip("venue"), F.lit("")) != "")
    return present & F.coalesce(
        ten.rlike(r"^\d{4}-\d{2}-\d{2}$") & ten.try_cast("date").isNotNull(), F.lit(False))


def normalize(raw: DataFrame) -> DataFrame:
    """Valid raw records in canonical form, keyed. See ``rejects`` for the rest."""
    title, venue = strip("title"), strip("venue")
    return raw.where(is_valid()).select(
        "seq", "precedence",
        dedupe_key(title, "date", venue).alias("dedupe_key"),
        F.coalesce(truthy("source"), F.lit("api")).alias("source"),
        F.coalesce(truthy("source_name"), truthy("source"), F.lit("unknown")).alias("source_name"),
        title.alias("title"), truthy("artist").alias("artist"),
        venue.alias("venue"), truthy("city").alias("city"),
        F.substring("date", 1, 10).try_cast("date").alias("event_date"),
        truthy("time").alias("event_time"), truthy("doors_time").alias("doors_time"),
        category_clamp("category").alias("category"),
        F.coalesce("genre_tags", F.lit("")).alias("genre_tags"),
        url_guard("ticket_url").alias("ticket_url"),
        url_guard("image_url").alias("image_url"),
        truthy("price_range").alias("price_range"),
    )


def rejects(raw: DataFrame) -> DataFrame:
    return raw.where(~is_valid())


def record_id(batch: DataFrame) -> Column:
    kind = batch.schema["seq"].dataType
    if not isinstance(kind, T.StructType):
        return F.col("seq")
    told = F.concat_ws("|", *[F.coalesce(F.col("seq")[f].cast("string"), F.lit("")) for f in kind.names])
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def as_table(batch: DataFrame, batch_time: Column) -> DataFrame:
    """A normalised batch with the columns of the stored table.

    ``seq`` orders the records of an adapter; it may be a number, which is the id too, or a struct such as
    (document, block, place), whose id is 60 bits of a hash of its fields.
    """
    return batch.select(
        "*", record_id(batch).alias("id"), batch_time.alias("created_at"), batch_time.alias("updated_at"),
        F.lit(False).alias("interested"), F.lit(False).alias("hidden"))


def upsert(target: DataFrame | None, batch: DataFrame, batch_time: Column) -> DataFrame:
    """Merge a normalised batch into the stored table.

    One shuffle on the key. Both ``max_by`` and ``min_by`` combine map-side, so
    a key that holds a third of the batch reaches its reducer as one row per
    task. Within the batch the highest precedence, then the latest row, wins
    every mutable field; nulls overwrite. ``id``, ``created_at`` and the user
    flags come from the first write.
    """
    rows = as_table(batch, batch_time).withColumn(
        "written", F.struct(F.lit(1).alias("run"), F.col("precedence"), F.col("seq")))
    if target is not None:
        stored = target.withColumn("written", F.struct(
            F.lit(0).alias("run"), F.lit(0).alias("precedence"), F.lit(None).cast(batch.schema["seq"].dataType).alias("seq")))
        rows = stored.select("dedupe_key", *MUTABLE, *KEPT, "updated_at", "written").unionByName(
            rows.select("dedupe_key", *MUTABLE, *KEPT, "updated_at", "written"))
    merged = rows.groupBy("dedupe_key").agg(
        F.max_by(F.struct(*MUTABLE), "written").alias("last"),
        F.min_by(F.struct(*KEPT), "written").alias("first"),
        F.max("updated_at").alias("updated_at"))
    return merged.select("dedupe_key", "last.*", "first.*", "updated_at")


def upsert_counts(target: DataFrame | None, raw: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """One row: found, added, updated, invalid.

    A key repeated inside the batch is added once and updated after that. ``clean`` is what ``normalize`` made of
    ``raw``, if a caller keeps it: then the keys are not computed again, and of ``raw`` only rows are counted.
    """
    if clean is None:
        flagged = raw.select(F.when(is_valid(), dedupe_key(strip("title"), "date", strip("venue"))).alias("dedupe_key"))
        per_key = flagged.groupBy("dedupe_key").agg(F.count("*").alias("n"))
    else:
        per_key = clean.groupBy("dedupe_key").agg(F.count("*").alias("n"))
        rest = raw.agg(F.count("*").alias("n")).unionByName(clean.agg((-F.count("*")).alias("n"))).agg(F.sum("n").alias("n"))
        per_key = per_key.unionByName(rest.select(F.lit(None).cast("string").alias("dedupe_key"), "n"))
    if target is None:
        known = per_key.withColumn("known", F.lit(None).cast("boolean"))
    else:
        known = per_key.join(
            target.select("dedupe_key", F.lit(True).alias("known")), "dedupe_key", "left")
    valid = F.col("dedupe_key").isNotNull()
    totals = known.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("found"),
        F.count_if(valid & F.col("known").isNull()).alias("added"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid"))
    return totals.select(
        "found", "added", (F.col("valid") - F.col("added")).alias("updated"),
        (F.col("found") - F.col("valid")).alias("invalid"))


def last_write_wins(batch: DataFrame) -> DataFrame:
    """One row per key: the last adapter in order, then the latest row."""
    rest = [c for c in batch.columns if c != "dedupe_key"]
    return (batch.groupBy("dedupe_key")
            .agg(F.max_by(F.struct(*rest), F.struct("precedence", "seq")).alias("last"))
            .select("dedupe_key", "last.*"))


def ok_runs_only(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """Records of runs that ended ``ok``; a failed run loses its partial records."""
    return batch.join(runs.where(F.col("status") == "ok").select("run_id"), "run_id", "left_semi")


def run_counts(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: records found, and how many of them may be merged."""
    found = batch.groupBy("run_id").agg(F.count("*").alias("found"))
    return runs.select("run_id", "source_name", "status").join(found, "run_id", "left").select(
        "run_id", "source_name", "status", F.coalesce("found", F.lit(0)).alias("found"),
        F.when(F.col("status") == "ok", F.coalesce("found", F.lit(0))).otherwise(0).alias("eligible"))


def duplicates_report(batch: DataFrame) -> DataFrame:
    """Keys written more than once: one row per key and source that wrote it.

    Rows, not a collected list, so a key written by very many sources stays
    spread out. ``n`` counts the source's writes, ``n_key`` all of the key's.
    """
    per_source = batch.groupBy("dedupe_key", "source_name").agg(F.count("*").alias("n"))
    repeated = per_source.groupBy("dedupe_key").agg(
        F.sum("n").alias("n_key"), F.count("*").alias("n_sources")).where(F.col("n_key") > 1)
    return per_source.join(repeated, "dedupe_key")


def manual_records(form: DataFrame) -> DataFrame:
    """User-entered rows as raw records: aliases resolved, required fields checked."""
    need = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("title", "date", "venue")]
    return form.where(reduce(Column.__and__, need)).select(
        "seq", F.lit("manual").alias("source"), F.lit("manual").alias("source_name"),
        F.lit(len(ADAPTER_ORDER)).alias("precedence"),
        "title", truthy("artist").alias("artist"), "venue", truthy("city").alias("city"),
        "date", truthy("time").alias("time"), truthy("doors_time").alias("doors_time"),
        F.coalesce(truthy("category"), F.lit("other")).alias("category"),
        F.coalesce(truthy("tags"), truthy("genre_tags"), F.lit("")).alias("genre_tags"),
        F.coalesce(truthy("url"), truthy("ticket_url")).alias("ticket_url"),
        truthy("image_url").alias("image_url"), truthy("price_range").alias("price_range"))


def refresh_one_source(target: DataFrame, batch: DataFrame, source_name: str,
                       known: DataFrame, batch_time: Column) -> DataFrame:
    """Merge only one source's records; an unregistered source is an error."""
    if known.where(F.col("source_name") == source_name).limit(1).count() == 0:
        raise ValueError(f"Unknown source: {source_name}")
    return upsert(target, batch.where(F.col("source_name") == source_name), batch_time)


def source_defaults(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill venue, city, category and tags from the record's registry row.

    The join carries no broadcast hint: a registry under the session's
    broadcast threshold is broadcast, a larger one is shuffled.
    """
    reg = registry.select(
        F.coalesce(truthy("id"), F.col("name")).alias("source_name"),
        F.coalesce(truthy("venue"), F.col("name")).alias("reg_venue"),
        truthy("city").alias("reg_city"), truthy("category").alias("reg_category"))
    joined = batch.join(reg, "source_name", "left")
    return joined.select(
        *[c for c in batch.columns if c not in ("venue", "city", "category", "genre_tags")],
        F.coalesce(truthy("venue"), "reg_venue").alias("venue"),
        F.coalesce(truthy("city"), "reg_city").alias("city"),
        F.coalesce(truthy("category"), "reg_category", F.lit("music")).alias("category"),
        F.coalesce("reg_category", "genre_tags", F.lit("")).alias("genre_tags"))


def union_sources(by_adapter: dict[str, DataFrame]) -> DataFrame:
    """Records of all adapters, each stamped with its place in the run order."""
    unknown = set(by_adapter) - set(ADAPTER_ORDER)
    if unknown:
        raise ValueError(f"Unknown adapter: {sorted(unknown)}")
    parts = [by_adapter[name].withColumn("precedence", F.lit(place))
             for place, name in enumerate(ADAPTER_ORDER) if name in by_adapter]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def artists_of_interest(listings: DataFrame) -> DataFrame:
    """Distinct artists of interested listings: seeds for artist lookups."""
    return listings.where(F.col("interested") & (F.col("artist") != "")).select("artist").distinct()

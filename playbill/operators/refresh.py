"""A refresh: landed documents to raw records, the merged table and one log row per source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf
from playbill.functions.text import truthy
from playbill.operators.ingest import is_valid, normalize, union_sources, upsert
from playbill.schema import RAW_LISTING
from playbill.session import stored
from playbill.sources import feeds, html, jsonld, payloads

#: Adapters whose records carry another source than "api".
SOURCES = {"rss": "rss", "scraper": "scrape", "manual": "manual"}
UNREADABLE = "unreadable"


@dataclass(frozen=True)
class Landed:
    """What a reader made of documents: raw records, and (doc_id, source_name, reason) of what it could not use.

    Readers store what they parsed: rejects are told by it, and callers use records and rejects more than once.
    """

    records: DataFrame
    rejects: DataFrame


def raw_records(rows: DataFrame, place: Column, block: Column | None = None) -> DataFrame:
    """Mapped rows with all fields of a raw record; ``seq`` orders them by document, block and place, however large these are."""
    fields = [f for f in RAW_LISTING.fields if f.name not in ("seq", "precedence")]
    seq = F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if block is None else block).cast("long").alias("block"),
                   place.cast("long").alias("place"))
    return rows.select(seq.alias("seq"), *[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _without_record(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents no record came from."""
    made = records.select("seq.doc_id").distinct()
    return documents.join(made, "doc_id", "left_anti")


def read_api(documents: DataFrame, schema: str, mapper: Callable[..., DataFrame], as_of: AsOf, zone: str) -> Landed:
    """Payloads of one API: (doc_id, source_name, body) and what its mapper needs, one event each."""
    rows = mapper(payloads.parse_payloads(documents.drop("source_name"), schema), as_of, zone, ["doc_id"])
    records = stored(raw_records(rows, F.lit(0)), "records")
    lost = _without_record(documents, records)
    reason = F.when(F.try_parse_json("body").isNull(), "unreadable payload").otherwise("payload without a record")
    return Landed(records, lost.select("doc_id", "source_name", reason.alias("reason")))


def with_registry(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents with the fields of their registry entry; a source it does not know keeps its own name."""
    entry = registry.select(
        F.coalesce(truthy("id"), "name").alias("source_name"), F.col("name").alias("reg_name"), "type", F.col("url").alias("reg_url"),
        "venue", "city", "category", "selectors")
    return documents.join(entry, "source_name", "left").select(
        *documents.columns, F.coalesce("reg_name", "source_name").alias("feed_name"), F.col("type"), F.col("reg_url"),
        F.col("venue").alias("feed_venue"), F.col("city").alias("feed_city"), F.col("category").alias("feed_category"), "selectors")


def read_feeds(documents: DataFrame, registry: DataFrame, as_of: AsOf, zone: str) -> Landed:
    """Feed documents (doc_id, source_name, body), each read as its registry entry's type: jsonld, ical, else RSS or Atom."""
    known = with_registry(documents, registry)
    fields = ["doc_id", "source_name", "feed_name", "feed_venue", "feed_city", "feed_category"]
    kind = F.coalesce("type", F.lit("rss"))
    plain = known.where(~kind.isin("jsonld", "ical"))
    rss = feeds.map_rss(feeds.rss_items(plain.select(*fields, "body")), as_of, zone, ["doc_id", "pos"])
    calendars = known.where(kind == "ical")
    events = feeds.ical_events(calendars.select(*fields, "body"))
    ical = feeds.map_ical(events, as_of, zone, ["doc_id", "pos"])
    marked = known.where(kind == "jsonld")
    found = jsonld.jsonld_listings(marked.select(F.col("doc_id").alias("page_id"), F.col("reg_url").alias("url"), F.col("body").alias("html")), as_of, zone)
    own = found.withColumnRenamed("page_id", "doc_id").join(marked.select(*fields), "doc_id")
    ld = own.select(
        *[c for c in own.columns if c not in ("venue", "city", "category", "genre_tags")], F.lit("rss").alias("source"),
        F.coalesce(truthy("venue"), truthy("feed_venue"), "feed_name").alias("venue"), F.coalesce(truthy("city"), truthy("feed_city")).alias("city"),
        F.coalesce(truthy("category"), truthy("feed_category"), F.lit("music")).alias("category"),
        F.coalesce(truthy("feed_category"), "genre_tags").alias("genre_tags"))
    records = stored(raw_records(rss, F.col("pos")).unionByName(raw_records(ical, F.col("pos"))).unionByName(
        raw_records(ld, F.col("place"), F.col("block"))), "records")
    text = F.coalesce("body", F.lit(""))
    readable = (F.when(kind == "jsonld", text.rlike("(?i)<script")).when(kind == "ical", text.contains("BEGIN:VCALENDAR"))
                .otherwise(text.rlike(r"(?i)<(rss|feed|rdf)\b")))
    lost = _without_record(known, records)
    rejects = lost.select("doc_id", "source_name", F.when(readable, "feed without a record").otherwise("unreadable feed").alias("reason"))
    return Landed(records, rejects.unionByName(feeds.zone_rejects(events, ["doc_id", "source_name"])))


def read_pages(pages: DataFrame, registry: DataFrame, as_of: AsOf, zone: str, max_items: int | None = html.MAX_ITEMS) -> Landed:
    """Scraped pages (doc_id, source_name, url, html), with the selectors of their registry entry."""
    known = with_registry(pages, registry)
    items = stored(html.html_items(known.select(F.col("doc_id").alias("page_id"), "url", "html", "source_name", "selectors")), "items")
    sites = registry.select(F.coalesce(truthy("id"), "name").alias("source_name"), "name", "venue", "city", "category", "url")
    rows = html.map_items(items, sites, as_of, zone, max_items=max_items).withColumnRenamed("page_id", "doc_id")
    rejects = html.rejected_items(items, as_of, zone, max_items=max_items).select(F.col("page_id").alias("doc_id"), "source_name", "reason")
    return Landed(stored(raw_records(rows, F.col("pos")), "records"), rejects)


def failed_documents(landed: dict[str, Landed]) -> DataFrame:
    """(adapter, doc_id, source_name, source, reason) of documents that could not be read, one row each."""
    parts = [part.rejects.where(F.col("reason").startswith(UNREADABLE)).groupBy("doc_id").agg(
        F.min("source_name").alias("source_name"), F.min("reason").alias("reason")).select(
        F.lit(adapter).alias("adapter"), F.col("doc_id").cast("long").alias("doc_id"), "source_name",
        F.lit(SOURCES.get(adapter, "api")).alias("source"), "reason") for adapter, part in landed.items()]
    return reduce(DataFrame.unionByName, parts)


def gather(landed: dict[str, Landed]) -> DataFrame:
    """Raw records of all adapters in their order. A document that could not be read loses what it gave so far, and no other does."""
    def good(part: Landed) -> DataFrame:
        bad = part.rejects.where(F.col("reason").startswith(UNREADABLE)).select(F.col("doc_id").cast("long").alias("_doc")).distinct()
        return part.records.withColumn("_of", F.col("seq.doc_id")).join(bad, F.col("_of") == F.col("_doc"), "left_anti").drop("_of")

    return union_sources({adapter: good(part) for adapter, part in landed.items()})


def refresh(target: DataFrame | None, landed: dict[str, Landed], batch_time: Column) -> DataFrame:
    """The stored table after all adapters ran."""
    return upsert(target, normalize(gather(landed)), batch_time)


def refresh_log(target: DataFrame | None, landed: dict[str, Landed], batch_time: Column) -> DataFrame:
    """One row per source: status, found, added, updated, invalid, and how many documents failed, with the first reason.

    A source is in error if none of its documents gave a record and one could not be read. A key counts as added for the
    source that wrote it first in the run, unless the table held it. Keys are reduced to their first
    writer map-side, so a key that many sources repeat is a row for each task.
    """
    raw = gather(landed)
    named = F.coalesce(truthy("source_name"), truthy("source"), F.lit("unknown"))
    found = raw.groupBy(named.alias("source_name"), F.coalesce(truthy("source"), F.lit("api")).alias("source")).agg(
        F.count("*").alias("found"), F.count_if(is_valid()).alias("valid"))
    first = normalize(raw).groupBy("dedupe_key").agg(
        F.min_by(F.struct("source_name", "source"), F.struct("precedence", "seq")).alias("w")).select("dedupe_key", "w.*")
    if target is not None:
        first = first.join(target.select("dedupe_key"), "dedupe_key", "left_anti")
    key = ["source_name", "source"]
    added = first.groupBy(*key).agg(F.count("*").alias("added"))
    errors = failed_documents(landed).groupBy(*key).agg(F.count("*").alias("failed_docs"), F.min("reason").alias("error_msg"))
    rows = found.join(added, key, "left").join(errors, key, "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        *key, F.when((n("found") == 0) & (n("failed_docs") > 0), "error").otherwise("ok").alias("status"),
        n("found").alias("found"), n("added").alias("added"), (n("valid") - n("added")).alias("updated"),
        (n("found") - n("valid")).alias("invalid"), n("failed_docs").alias("failed_docs"), "error_msg", batch_time.alias("run_at"))


DEAD_LETTER = "adapter string, doc_id long, source_name string, reason string, attempt long, run_at timestamp_ntz"


def dead_letters(landed: dict[str, Landed], log: DataFrame | None, batch_time: Column) -> DataFrame:
    """Rows to append to the dead-letter log (DEAD_LETTER): documents this run could not read, with the number of the attempt."""
    failed = failed_documents(landed).select("adapter", "doc_id", "source_name", "reason")
    if log is None:
        return failed.select("*", F.lit(1).cast("long").alias("attempt"), batch_time.alias("run_at"))
    before = log.groupBy("adapter", "doc_id").agg(F.max("attempt").alias("tried"))
    return failed.join(before, ["adapter", "doc_id"], "left").select(
        *failed.columns, (F.coalesce("tried", F.lit(0)) + 1).cast("long").alias("attempt"), batch_time.alias("run_at"))


def open_letters(log: DataFrame, read: DataFrame) -> DataFrame:
    """Per document of the log its last failure, without those a run has read since; ``read`` has (adapter, doc_id, run_at)."""
    last = log.groupBy("adapter", "doc_id").agg(F.max_by(F.struct("source_name", "reason", "attempt", "run_at"), "attempt").alias("last"))
    last = last.select("adapter", "doc_id", "last.*")
    since = read.groupBy("adapter", "doc_id").agg(F.max("run_at").alias("read_at"))
    return last.join(since, (last["adapter"] == since["adapter"]) & (last["doc_id"] == since["doc_id"]) & (since["read_at"] > last["run_at"]), "left_anti")


def to_replay(documents: DataFrame, letters: DataFrame, adapter: str) -> DataFrame:
    """The landed documents of an adapter that wait in the open letters."""
    return documents.join(letters.where(F.col("adapter") == adapter).select("doc_id"), "doc_id", "left_semi")


def replay(before: DataFrame | None, after: DataFrame, records: DataFrame, repaired: DataFrame, batch_time: Column) -> DataFrame:
    """The table as it were if the repaired documents had been good in the run that made ``after`` out of ``before``.

    ``records`` are the run's raw records as gathered, ``repaired`` those of the repaired documents; both are read more than
    once, so they should be stored. Only keys that repaired documents write are merged again, from all records of the run;
    every other row is taken as it stands. User flags stay those of ``after``.
    """
    late = normalize(repaired)
    touched = late.select("dedupe_key").distinct()
    run = normalize(records).unionByName(late).join(touched, "dedupe_key", "left_semi")
    held = None if before is None else before.join(touched, "dedupe_key", "left_semi")
    merged = upsert(held, run, batch_time)
    flags = after.select("dedupe_key", F.col("interested").alias("_interested"), F.col("hidden").alias("_hidden"))
    kept = merged.join(flags, "dedupe_key", "left").withColumns({
        "interested": F.coalesce("_interested", "interested"), "hidden": F.coalesce("_hidden", "hidden")}).select(*merged.columns)
    return after.join(touched, "dedupe_key", "left_anti").select(*merged.columns).unionByName(kept)

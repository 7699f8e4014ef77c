"""Streams against their batch twins, on files that arrive in two parts."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playbill.operators.ingest import normalize, upsert, upsert_counts
from playbill.plans import streams
from playbill.plans import tables as tb
from playbill.sinks import ics, snapshots
from playbill.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def stamp(_=0):
    return tb.ntz("2024-02-01 00:00:00")



@pytest.fixture
def halves(spark, tmp_path):
    events = tb.read(spark, FOLDER, "events")
    first, second = events.where("event_type in ('view', 'click')"), events.where("event_type not in ('view', 'click')")
    for i, part in enumerate((first, second)):
        part.coalesce(1).write.parquet(str(tmp_path / f"events{i}.parquet"))
    return str(tmp_path), first, second


def plain(df):
    return {tuple(r) for r in df.drop("created_at", "updated_at").collect()}


def ordered(df):
    return df.select(sorted(df.columns))


def test_upsert_equals_batches_in_order(spark, halves, tmp_path):
    folder, first, second = halves
    root = str(tmp_path / "table")
    raws = [tb.raw_listings(spark, FOLDER, part) for part in (first, second)]
    expected = upsert(upsert(None, normalize(raws[0]), stamp()), normalize(raws[1]), stamp())
    for i, raw in enumerate(raws):
        snapshots.write_batch(spark, root, normalize(raw), i, stamp())
    assert plain(ordered(snapshots.current(spark, root))) == plain(ordered(expected))
    # Running the last batch again changes nothing.
    snapshots.write_batch(spark, root, normalize(raws[1]), 1, stamp())
    assert plain(ordered(snapshots.current(spark, root))) == plain(ordered(expected))


def test_uncommitted_batch_is_invisible(spark, halves, tmp_path):
    _, first, second = halves
    root = str(tmp_path / "table")
    assert snapshots.current(spark, root) is None
    snapshots.write_batch(spark, root, normalize(tb.raw_listings(spark, FOLDER, first)), 0, stamp())
    before = plain(snapshots.current(spark, root))
    half_done = upsert(None, normalize(tb.raw_listings(spark, FOLDER, second)), stamp())
    half_done.write.partitionBy("event_date").parquet(f"{root}/segments/1-1-died")
    assert plain(snapshots.current(spark, root)) == before


def test_replaying_a_committed_batch_while_reading(spark, halves, tmp_path):
    _, first, second = halves
    root = str(tmp_path / "table")
    raws = [normalize(tb.raw_listings(spark, FOLDER, part)) for part in (first, second)]
    snapshots.write_batch(spark, root, raws[0], 0, stamp())
    snapshots.write_batch(spark, root, raws[1], 1, stamp())
    reader = snapshots.current(spark, root)
    snapshots.write_batch(spark, root, raws[1], 1, stamp())
    snapshots.write_batch(spark, root, raws[0], 0, stamp())
    assert plain(ordered(reader)) == plain(ordered(snapshots.current(spark, root)))
    assert len(snapshots._commits(spark, root)) == 2


def test_segments_are_merged_and_cleaned(spark, tmp_path):
    root, batch = str(tmp_path / "table"), normalize(tb.raw_listings(spark, FOLDER))
    parts = [batch.where(F.col("seq") % 7 == i) for i in range(7)]
    expected = None
    for i, part in enumerate(parts):
        snapshots.write_batch(spark, root, part, i, stamp(), fanout=3)
        expected = upsert(expected, part, stamp())
    assert [(s.first_batch, s.last_batch, s.level) for s in snapshots.live(snapshots._commits(spark, root))] == [(0, 2, 1), (3, 5, 1), (6, 6, 0)]
    assert plain(ordered(snapshots.current(spark, root))) == plain(ordered(expected))
    assert snapshots.current(spark, root, before=0) is None
    snapshots.clean(spark, root)
    snapshots.clean(spark, root)
    assert len(snapshots._commits(spark, root)) == 3 == len(list((tmp_path / "table" / "segments").iterdir()))
    assert plain(ordered(snapshots.current(spark, root))) == plain(ordered(expected))
    snapshots.write_batch(spark, root, parts[0], 0, stamp(), fanout=3)
    assert plain(ordered(snapshots.current(spark, root))) == plain(ordered(expected))


@pytest.mark.parametrize("steps", [0, 1, 4])
def test_clean_that_dies_half_way(spark, tmp_path, monkeypatch, steps):
    """After any number of removals the table is whole, a replayed batch is skipped, and the next ``clean`` ends the work."""
    root, batch = str(tmp_path / "table"), normalize(tb.raw_listings(spark, FOLDER))
    for i in range(4):
        snapshots.write_batch(spark, root, batch.where(F.col("seq") % 4 == i), i, stamp(), fanout=2)
    expected, left, remove = plain(ordered(snapshots.current(spark, root))), [steps], snapshots.remove

    def dying(session, path):
        if not left[0]:
            raise OSError("lost")
        left[0] -= 1
        remove(session, path)

    monkeypatch.setattr(snapshots, "remove", dying)
    with pytest.raises(OSError):
        snapshots.clean(spark, root)
    assert plain(ordered(snapshots.current(spark, root))) == expected
    before = len(snapshots._commits(spark, root))
    snapshots.write_batch(spark, root, batch.where(F.col("seq") % 4 == 1), 1, stamp(), fanout=2)
    assert len(snapshots._commits(spark, root)) == before
    monkeypatch.setattr(snapshots, "remove", remove)
    snapshots.clean(spark, root)
    assert plain(ordered(snapshots.current(spark, root))) == expected
    assert len(snapshots._commits(spark, root)) == 1 == len(list((tmp_path / "table" / "segments").iterdir()))


def test_days_prune_every_segment(spark, halves, tmp_path):
    _, first, second = halves
    root = str(tmp_path / "table")
    for i, part in enumerate((first, second)):
        snapshots.write_batch(spark, root, normalize(tb.raw_listings(spark, FOLDER, part)), i, stamp())
    plan = snapshots.current(spark, root).where("event_date = DATE '2024-01-10'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(event_date") == 2


def test_stream_upsert_over_two_files(spark, halves, tmp_path):
    folder, first, second = halves
    root = str(tmp_path / "table")
    stream = (spark.readStream.schema(tb.SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
              .parquet(f"{folder}/events*.parquet"))
    jobs.stream_upsert(tb.raw_listings(spark, FOLDER, stream), root, stamp)
    keys = {r.dedupe_key for r in snapshots.current(spark, root).select("dedupe_key").collect()}
    both = normalize(tb.raw_listings(spark, FOLDER, first.unionByName(second)))
    assert keys == {r.dedupe_key for r in both.select("dedupe_key").distinct().collect()}
    assert snapshots.current(spark, root).count() == len(keys)


def _landing(spark, folder, schema, parts):
    """A stream of one file a micro-batch, in the given order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    kind = spark.read.parquet(f"{folder}/0").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_interest_meets_listings_that_come_later(spark, tmp_path):
    """Marks before their listing, after it, repeated, without an id, and too far from it."""
    day = lambda n: dt.datetime(2024, 1, n, 20, 0)
    listings = [[(1, "rock, indie", "Ann", day(1)), (2, "jazz", None, day(1))], [(3, "", "Bo", day(3)), (4, None, "", day(3))]]
    marks = [[(3, day(2)), (1, day(2)), (None, day(2))], [(1, day(3)), (4, day(3)), (9, day(3)), (2, day(9))]]
    got = jobs.appended(jobs.interest_signals(
        _landing(spark, str(tmp_path / "m"), "id bigint, ts timestamp_ntz", marks),
        _landing(spark, str(tmp_path / "l"), "id bigint, genre_tags string, artist string, ts timestamp_ntz", listings),
        "10 days", "3 days"), "interest")
    assert Counter(map(tuple, got.collect())) == Counter(
        [(tag, day(n)) for n in (2, 3) for tag in ("rock", "indie", "ann")] + [("bo", day(2))])


def test_append_mode_withholds_open_days(spark):
    events = tb.event_stream(spark, FOLDER).select(F.col("ts").cast("timestamp").alias("at"))
    got = {tuple(r) for r in jobs.latest_per_key(jobs.day_counts(events, "at", "1 day"), ["event_date"], "days", "append").collect()}
    batch = {tuple(r) for r in tb.read(spark, FOLDER, "events").groupBy(
        F.col("ts").cast("date")).agg(F.count("*")).collect()}
    assert got <= batch
    last = max(d for d, _ in batch)
    assert all((last - d).days <= 2 for d, _ in batch - got)


def test_calendar_file(spark, tmp_path):
    rows = [(1, "Punk; Rock, Night\\Out", "The Spot", "Seattle", "2026-07-04", "20:00", "rock", "https://venue.example/t/1", True),
            (2, "All day", "The Spot", "", "2026-07-03", None, "", None, True), (3, "No", "X", "", "2026-07-01", None, "", None, False)]
    df = spark.createDataFrame(rows, "id long, title string, venue string, city string, d string, event_time string, "
                                     "genre_tags string, ticket_url string, interested boolean")
    df = df.select("*", F.col("d").cast("date").alias("event_date"), F.lit(None).cast("string").alias("artist"),
                   F.lit(None).cast("string").alias("price_range"))
    path = tmp_path / "cal"
    ics.write_ics(df, str(path), "2026-06-01 08:00:00")
    text = b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))).decode()
    lines = text.split("\r\n")
    assert lines[:2] == ["BEGIN:VCALENDAR", "VERSION:2.0"] and lines[-2:] == ["END:VCALENDAR", ""]
    assert text.count("BEGIN:VEVENT") == text.count("END:VEVENT") == 2
    assert lines.index("DTSTART;VALUE=DATE:20260703") < lines.index("DTSTART:20260704T200000")
    assert "SUMMARY:Punk\\; Rock\\, Night\\\\Out" in lines and "LOCATION:The Spot\\, Seattle" in lines
    assert "DESCRIPTION:Genres: rock\\nTickets: https://venue.example/t/1" in lines
    assert "DTSTAMP:20260601T080000Z" in lines


def test_a_landing_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Each turn is one micro-batch over several small files, and turns keep the order of event_id."""
    monkeypatch.setattr(streams, "ROWS_A_FILE", 40)
    root, seen = str(tmp_path / "turns"), []
    for i, landed in enumerate(streams._landings(spark, FOLDER, root)):
        assert len(list((tmp_path / "turns" / "landed" / f"part={i}").glob("*.parquet"))) > 2

        def keep(batch, batch_id):
            seen.append((batch_id, *batch.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()))

        jobs.drain(landed, root, keep)
    low, high, n = tb.read(spark, FOLDER, "events").agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    assert [s[0] for s in seen] == [0, 1, 2, 3] and sum(s[3] for s in seen) == n
    assert seen[0][1] == low and seen[3][2] == high and all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False))


def test_counts_from_kept_rows(spark):
    """Counts of a batch are those of its normalised rows and of the number of raw ones."""
    raw = tb.raw_listings(spark, FOLDER)
    known = normalize(raw.where("seq % 3 = 0")).select("dedupe_key").distinct()
    for rows in (raw, raw.where("seq < 0"), raw.where("title = ''")):
        for target in (None, known):
            assert upsert_counts(target, rows, normalize(rows)).collect() == upsert_counts(target, rows).collect()

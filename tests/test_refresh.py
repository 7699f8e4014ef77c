"""Refreshes with documents that cannot be read, and their replay."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from playbill import plans
from playbill.operators import refresh as rf
from playbill.operators.ingest import normalize, upsert
from playbill.plans.registry import QUERIES
from playbill.plans.tables import ntz
from playbill.schema import REGISTRY
from playbill.session import stored
from playbill.sources import feeds as feeds_reader

plans.load_all()
NOW, T1, T2 = dt.date(2026, 7, 2), "2026-07-02 00:00:00", "2026-07-02 06:00:00"


def entry(title, day):
    return f"<item><title>{title}</title><pubDate>2026-08-{day:02d}T20:00:00Z</pubDate></item>"


def feeds(spark, docs, kind="rss", source="site"):
    registry = spark.createDataFrame([{"id": source, "name": source, "type": kind, "url": "https://s.example/", "venue": "Hall"}], REGISTRY)
    return rf.read_feeds(spark.createDataFrame([(i, source, b) for i, b in docs], "doc_id long, source_name string, body string"), registry, NOW, "UTC")


def rss(*items):
    return "<rss><channel>" + "".join(items) + "</channel></rss>"


GOOD = [(i, rss(entry(f"Show {i}", i), entry("Shared", 20))) for i in range(1, 10)]
REPAIRED = rss(entry("Show 10", 10), entry("Shared", 20), entry("Show 3", 3))


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(set(df.columns) - {"created_at", "updated_at"})).collect()), key=str)


@pytest.fixture(scope="module")
def run(spark):
    return {"rss": feeds(spark, [*GOOD, (10, None)])}


def test_one_bad_document_of_ten_leaves_nine(spark, run):
    raw = rf.gather(run)
    assert raw.count() == 18 and {r[0] for r in raw.select("seq.doc_id").collect()} == set(range(1, 10))
    (row,) = rf.refresh_log(None, run, ntz(T1)).collect()
    assert (row.source_name, row.source, row.status, row.found, row.added, row.updated, row.failed_docs, row.error_msg) == (
        "site", "rss", "ok", 18, 10, 8, 1, "unreadable feed")


def test_a_source_without_a_good_document_is_in_error_under_its_own_kind(spark):
    landed = {"rss": feeds(spark, [(1, None), (2, "<html>gone</html>")])}
    (row,) = rf.refresh_log(None, landed, ntz(T1)).collect()
    assert (row.source_name, row.source, row.status, row.found, row.failed_docs) == ("site", "rss", "error", 0, 2)


def test_a_good_document_without_records_is_no_failure(spark):
    landed = {"rss": feeds(spark, [(1, rss()), (2, rss(entry("A", 1)))])}
    (row,) = rf.refresh_log(None, landed, ntz(T1)).collect()
    assert (row.status, row.found, row.failed_docs, row.error_msg) == ("ok", 1, 0, None)
    assert rf.failed_documents(landed).count() == 0


@pytest.mark.parametrize("earlier", [False, True])
def test_replay_is_as_if_it_had_been_good_at_once(spark, run, earlier):
    before = None
    if earlier:
        old = {"rss": feeds(spark, [(1, rss(entry("Show 10", 10), entry("Old", 9)))], source="old")}
        before = stored(rf.refresh(None, old, ntz("2026-07-01 00:00:00")), "before")
    after = stored(rf.refresh(before, run, ntz(T1)), "after")
    records, late = stored(rf.gather(run), "records"), stored(rf.gather({"rss": feeds(spark, [(10, REPAIRED)])}), "late")
    expected = rf.refresh(before, {"rss": feeds(spark, [*GOOD, (10, REPAIRED)])}, ntz(T1))
    assert rows(rf.replay(before, after, records, late, ntz(T1))) == rows(expected)
    hidden = after.withColumn("hidden", F.col("title") == "Show 3")
    done = {r.title: r.hidden for r in rf.replay(before, hidden, records, late, ntz(T1)).collect()}
    assert done["Show 3"] and not done["Show 10"]


def test_dead_letters_count_attempts_and_close_when_read(spark, run):
    first = stored(rf.dead_letters(run, None, ntz(T1)), "first")
    assert [(r.adapter, r.doc_id, r.source_name, r.reason, r.attempt) for r in first.collect()] == [("rss", 10, "site", "unreadable feed", 1)]
    log = first.unionByName(rf.dead_letters({"rss": feeds(spark, [(10, None)])}, first, ntz(T2)))
    nothing = spark.createDataFrame([], "adapter string, doc_id long, run_at timestamp_ntz")
    assert [(r.doc_id, r.attempt) for r in rf.open_letters(log, nothing).collect()] == [(10, 2)]
    documents = spark.createDataFrame([(9, "a"), (10, "b"), (10, "c")], "doc_id long, body string")
    assert sorted(r.body for r in rf.to_replay(documents, rf.open_letters(log, nothing), "rss").collect()) == ["b", "c"]
    assert rf.to_replay(documents, rf.open_letters(log, nothing), "scraper").count() == 0
    read = lambda at: spark.range(1).select(F.lit("rss").alias("adapter"), F.lit(10).cast("long").alias("doc_id"), ntz(at).alias("run_at"))
    assert rf.open_letters(log, read("2026-07-03 00:00:00")).count() == 0
    assert rf.open_letters(log, read("2026-07-01 00:00:00")).count() == 1


def test_order_numbers_never_meet(spark):
    """Two blocks, one of more than a thousand events, and ids of any size."""
    event = lambda n: {"@type": "Event", "name": f"E {n}", "startDate": "2026-08-05"}
    tag = lambda doc: f'<script type="application/ld+json">{json.dumps(doc)}</script>'
    body = tag([event(n) for n in range(1002)]) + tag([event(n) for n in range(2000, 2003)])
    landed = feeds(spark, [(2**62, body), (2**62 + 1, body)], kind="jsonld")
    assert landed.records.count() == 2010 == landed.records.select("seq").distinct().count()
    table = upsert(None, normalize(rf.gather({"rss": landed})), ntz(T1))
    assert table.count() == 1005 == table.select("id").distinct().count()


def test_unknown_zones_are_reported_and_fail_nothing(spark):
    body = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:x\r\nDTSTART;TZID=Some Time:20260704T200000\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    landed = feeds(spark, [(1, body)], kind="ical")
    assert [r.reason for r in landed.rejects.collect()] == ["time zone not known: Some Time"]
    assert rf.gather({"rss": landed}).count() == 1


def test_documents_are_parsed_once(spark, run):
    """What is asked of a refresh reads stored records; no document is parsed again for its rejects."""
    asked = [rf.gather(run), rf.refresh_log(None, run, ntz(T1)), rf.dead_letters(run, None, ntz(T1)), QUERIES["isolate_failures"](spark, "/root/testdata/sf0.001")]
    for df in asked:
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "mapinarrow" not in plan and "xmltostructs" not in plan and "from_xml" not in plan and "from_json" not in plan


def test_calendar_files_are_read_one_kind_at_a_time(spark, tmp_path, monkeypatch):
    asked, read = [], feeds_reader.read_records
    monkeypatch.setattr(feeds_reader, "read_records", lambda s, p, kinds, **o: asked.append(kinds) or read(s, p, kinds, **o))
    (tmp_path / "a.ics").write_bytes(b"BEGIN:VEVENT\r\nDTSTART:20240101T000000Z\r\nEND:VEVENT\r\n")
    assert feeds_reader.ical_file_events(spark, str(tmp_path)).count() == 1
    assert asked == [["vtimezone"], ["vevent"]]

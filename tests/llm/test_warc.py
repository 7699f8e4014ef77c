import hashlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from playbill.llm import warc

SCHEMA = "page_id bigint, url string, html string"
BIG = "<p>payload WARC/1.1\r\n\r\n</p>" * 60
PAGES = [
    (1, "http://a/", BIG), (2, "http://b/", BIG), (3, "http://c/", BIG), (4, "http://d/\r\nWARC-Type: revisit", "small"), (5, None, "small"),
    (6, "http://é/ x", None), (7, "http://e/", ""), (8, "http://f/", "é" * 499), (9, "http://g/", "é" * 499), (10, "http://h/", "é" * 500), (11, "http://i/", "é" * 500),
    (None, None, BIG + "x"), (12, "http://j/", "y" * 3_000_000), (13, "http://k/", "\r\n\r\n" * 300),
]


@pytest.fixture(scope="module", params=[0, 3])
def archives(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumns({"record_type": F.lit("clash"), "PAYLOAD": F.lit(0)})
    warc.write_archives(pages.repartition(3), path, level=request.param, max_bytes=4000)
    return path


def told(df):
    return sorted(((r["id"], r["record_type"], r["ref"], r["payload_bytes"], r["payload_digest"], r["payload"] and bytes(r["payload"])) for r in df.withColumns(
        {"id": warc.page_of(F.col("record_id")), "ref": warc.page_of(F.col("refers_to"))}).collect()), key=str)


def want():
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        kept = max(same, default=None) if len(data) >= 1000 else i
        out.append((i, "response" if kept == i else "revisit", None if kept == i else kept, len(data), hashlib.sha1(data).hexdigest(), data if kept == i else None))
    return sorted(out, key=str)


def test_round_trip(spark, archives):
    assert told(warc.read_archives(spark, archives)) == want()
    assert told(warc.read_archives(spark, archives, partition_bytes=1)) == want()
    files = list(Path(archives).glob("*.warc*"))
    assert len(warc.WarcReader({"path": archives, "partition_bytes": "1"}).partitions()) == len(files) > 1
    assert len(warc.WarcReader({"path": archives}).partitions()) == 1


@pytest.mark.parametrize("where", [
    "record_type = 'revisit'", "record_type IN ('response')", "target_uri LIKE 'http://a%'", "refers_to IS NULL", "target_uri IS NOT NULL AND record_type = 'response'",
    "payload_bytes > 1000 AND record_type = 'response'", "record_id = '<urn:page:12>' OR target_uri = 'http://e/'"])
def test_predicates(spark, archives, where):
    every = warc.read_archives(spark, archives).collect()
    found = warc.read_archives(spark, archives).where(where).collect()
    assert sorted(r["record_id"] for r in found) == sorted(r["record_id"] for r in spark.createDataFrame(every, warc.SCHEMA).where(where).collect())


def test_predicates_reach_the_reader(spark, archives):
    reader = warc.WarcReader({"path": archives})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.IsNotNull(("payload",)), warc.In(("target_uri",), ("x",))]))
    assert [type(f).__name__ for f in kept] == ["IsNotNull"] and len(reader.tests) == 2
    assert not reader.passes({"record_type": "response", "target_uri": "x"}) and reader.passes({"record_type": "revisit", "target_uri": "x"})


def test_unwanted_payloads_are_not_decoded():
    class Counting(warc.Plain):
        taken = 0

        def take(self, n):
            Counting.taken += n
            return super().take(n)

    rows = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "target_uri": None, "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 100_000, "payload": b"x" * 100_000} for i in range(5)]
    data = b"".join(map(warc.record, rows))
    found = list(warc.walk(Counting(io.BytesIO(data)), lambda r: r["record_id"] == "<urn:page:3>", True))
    assert [len(r["payload"]) for r in found] == [100_000] and Counting.taken < 101_000
    assert [r["payload"] for r in warc.walk(warc.Plain(io.BytesIO(data)), lambda r: True, False)] == [None] * 5


def test_headers_only(spark, archives):
    rows = warc.read_archives(spark, archives, payloads="false").collect()
    assert len(rows) == len(PAGES) and all(r["payload"] is None for r in rows)


def test_archives_of_failed_tasks_are_not_read(spark, archives):
    stray = Path(archives) / "stray.warc"
    stray.write_bytes(warc.record({"record_type": "response", "record_id": "<urn:page:99>", "target_uri": None, "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 1, "payload": b"x"}))
    assert warc.read_archives(spark, archives).count() == len(PAGES)
    assert [r["record_id"] for r in warc.read_archives(spark, str(stray)).collect()] == ["<urn:page:99>"]


def test_a_cut_archive_is_an_error(tmp_path):
    row = {"record_type": "response", "record_id": "<urn:page:1>", "target_uri": None, "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 5000, "payload": b"x" * 5000}
    for source in (warc.Plain(io.BytesIO(warc.record(row)[:-100])), warc.Plain(io.BytesIO(warc.record(row)[:50]))):
        with pytest.raises(ValueError):
            list(warc.walk(source, lambda r: True, True))


def test_repeated_rows_are_responses_of_their_own(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a/", BIG), (1, "http://a/", BIG), (0, "http://b/", BIG)], SCHEMA), str(tmp_path / "w"))
    assert [r[:3] for r in told(warc.read_archives(spark, str(tmp_path / "w")))] == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]

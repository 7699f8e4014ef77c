"""Marked records of files read in parts, against patterns over whole texts."""

import io
import random
import re

import pytest
from pyspark.sql import functions as F

from playbill.sources import feeds, records


class Held:
    """Bytes with the calls of an open file that the reader uses."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return io.BytesIO(self.data[at:at + n]).read()


PIECES = {
    "item": ["<item>", "<item a='1'>", "<items>", "</item>", "</Item>", "<ITEM\n>", "<item", "text é ", "</ite", "m>", "<rss>", " "],
    "vevent": ["BEGIN:VEVENT", "END:VEVENT", "END:VEV\r\n ENT", "BEGIN:VEVENT\r\n", "END:VEVEN", "T", "\r\n ", "x", "BEG\n\tIN:VEVENT"],
}


@pytest.mark.parametrize("kind", PIECES)
@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_records_of_the_whole(kind, seed):
    rng = random.Random(seed)
    data = "".join(rng.choice(PIECES[kind]) for _ in range(rng.randrange(0, 60))).encode()
    opening, closing = records.MARKS[kind]
    whole = [(m.start(), m.group()) for m in re.finditer(b"(?s)%b.*?%b" % (opening, closing), data)]
    for size in (1, 2, 7, 50, len(data) + 1):
        got = [r for s in range(0, len(data), size)
               for r in records.records(Held(data), kind, s, min(s + size, len(data)), rng.choice([1, 5, 1000]))]
        assert got == whole, size


def test_no_closing_mark_looks_nothing_up():
    class Counting(Held):
        read = 0

        def read_at(self, n, at):
            Counting.read += n
            return super().read_at(n, at)

    data = Counting(b"<item>" + b"x" * 100_000)
    assert [r for s in range(0, data.size(), 1000) for r in records.records(data, "item", s, min(s + 1000, data.size()), 100)] == []
    assert Counting.read < 2 * data.size()


def test_unknown_kind(spark):
    with pytest.raises(Exception, match="Unknown kind"):
        records.read_records(spark, "/tmp", ["row"]).count()


RSS = ('<?xml version="1.0"?><rss><channel>' + "".join(
    f"<item><title>Show {i} &nbsp; A & B</title><link>https://f.example/{i}</link><pubDate>2024-01-07T20:00:00Z</pubDate></item>\n" for i in range(60))
    + "<item><title>cut off")
ATOM = '<feed>' + "".join(
    f"<entry><title>Atom {i}</title><link href='https://a.example/{i}' rel='alternate'/><updated>2024-01-08T20:00:00Z</updated></entry>" for i in range(20)) + "</feed>"


def _feeds(spark, named, body="body"):
    return spark.createDataFrame([(n, t) for n, t in named.items()], f"file string, {body} string").select(
        "file", body, F.col("file").alias("source_name"), F.lit("F").alias("feed_name"), F.lit("V").alias("feed_venue"),
        F.lit("C").alias("feed_city"), F.lit(None).cast("string").alias("feed_category"))


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_feed_files_in_parts(spark, tmp_path, part_bytes):
    named = {"a.xml": RSS, "deep/b.xml": ATOM, "empty.xml": "", "none.xml": "<html></html>"}
    for name, text in named.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "_SUCCESS").write_text("<item></item>")
    documents = _feeds(spark, named)
    whole = feeds.map_rss(feeds.rss_items(documents), "2024-01-01", "UTC", ["file"])
    items = feeds.rss_file_items(spark, str(tmp_path), part_bytes=part_bytes)
    parts = feeds.map_rss(items.join(documents.drop("body"), "file"), "2024-01-01", "UTC", ["file"])
    assert whole.count() == 80 and _rows(parts) == _rows(whole)
    assert part_bytes > 300 or items.rdd.getNumPartitions() > 1
    assert items.groupBy("file", "pos").count().where("count > 1").isEmpty()


ZONE = ("BEGIN:VTIMEZONE\r\nTZID:Office\r\nBEGIN:STANDARD\r\nDTSTART:19700101T000000\r\nTZOFFSETFROM:+0530\r\nTZOFFSETTO:+0530\r\n"
        "END:STANDARD\r\nEND:VTIMEZONE\r\n")


def _event(i):
    return f"BEGIN:VEVENT\r\nDTSTART;TZID=Office:20240106T2000{i % 60:02d}\r\nSUMMARY:Long\r\n  name {i}\r\nEND:VEV\r\n ENT\r\n"


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_calendar_files_in_parts(spark, tmp_path, part_bytes):
    events = "".join(map(_event, range(50)))
    named = {"first.ics": f"BEGIN:VCALENDAR\r\n{ZONE}{events}END:VCALENDAR", "last.ics": f"BEGIN:VCALENDAR\r\n{events}{ZONE}END:VCALENDAR",
             "without.ics": f"BEGIN:VCALENDAR\r\n{_event(1)}END:VCALENDAR", "cut.ics": "BEGIN:VEVENT\r\nSUMMARY:x"}
    for name, text in named.items():
        (tmp_path / name).write_bytes(text.encode())
    documents = _feeds(spark, named)
    read = feeds.ical_events(documents)
    whole = feeds.map_ical(read, "2024-01-01", "UTC", ["file"])
    found = feeds.ical_file_events(spark, str(tmp_path), part_bytes=part_bytes)
    parts = feeds.map_ical(found.join(documents.drop("body"), "file"), "2024-01-01", "UTC", ["file"])
    assert whole.count() == 101 and _rows(parts) == _rows(whole)
    assert _rows(feeds.zone_rejects(found, ["file"])) == _rows(feeds.zone_rejects(read, ["file"]))

"""Readers on literal documents and files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from playbill.operators import pages as pg
from playbill.sources import feeds, html, jsonld, payloads, registry

NOW = dt.date(2026, 7, 2)
WEST = "America/Los_Angeles"


def page(spark, body, url="https://venue.example/calendar"):
    return spark.createDataFrame([(1, url, body)], "page_id long, url string, html string")


def script(doc):
    return f'<html><head><script type="application/ld+json">{json.dumps(doc)}</script></head><body></body></html>'


NESTED = {
    "@context": "https://schema.org", "@type": "Place", "name": "Fixture Comedy Club",
    "Events": [
        {"@type": "Event", "name": "Headliner Night", "startDate": "2026-08-01T20:00:00-07:00",
         "location": {"@type": "Place", "name": "Fixture Comedy Club", "address": {"addressLocality": "Tacoma"}},
         "offers": {"price": "25", "url": "https://tix.example/1"}},
        {"@type": "ComedyEvent", "name": "Open Mic", "startDate": "2026-08-03T19:30:00-07:00"}],
}


def test_jsonld_nested_events(spark):
    a, b = jsonld.jsonld_listings(page(spark, script(NESTED)), NOW).orderBy("place").collect()
    assert (a.title, a.date, a.time, a.venue, a.city) == (
        "Headliner Night", dt.date(2026, 8, 1), "20:00", "Fixture Comedy Club", "Tacoma")
    assert (a.ticket_url, a.price_range, b.category) == ("https://tix.example/1", "$25", "comedy")


def test_jsonld_graph(spark):
    doc = {"@graph": [{"@type": "MusicEvent", "name": "Graph Band", "startDate": "2026-08-05"}]}
    (row,) = jsonld.jsonld_listings(page(spark, script(doc)), NOW).collect()
    assert (row.title, row.date) == ("Graph Band", dt.date(2026, 8, 5))


def deep(n):
    node = {"@type": "Event", "name": "E", "startDate": "2026-08-05"}
    for _ in range(n):
        node = {"k": node}
    return node


@pytest.mark.parametrize("depth", [0, 12, 13, 40, 300])
def test_jsonld_any_depth(spark, depth):
    blocks = jsonld.jsonld_blocks(page(spark, script(deep(depth))))
    (row,) = jsonld.jsonld_event_nodes(blocks).collect()
    assert (row.place, list(row.path)) == (0, [0] * depth) and blocks.first().depth == depth + 1
    assert jsonld.jsonld_listings(page(spark, script(deep(depth))), NOW).count() == 1


def test_jsonld_limit_of_a_caller(spark):
    blocks = jsonld.jsonld_blocks(page(spark, script(deep(12))).union(page(spark, script(deep(13)))))
    assert jsonld.jsonld_event_nodes(blocks, limit=12).count() == 1
    assert [r.reason for r in jsonld.truncated_blocks(blocks, 12).collect()] == ["truncated: nested 14 deep, searched to 12"]


def test_nesting_ignores_brackets_in_strings(spark):
    docs = ['{"a": "[[[{{{"}', '["\\\\", "\\"[", [1, {"x": []}]]', '7', '', '{"a": {"b": [' + ",".join(["[]"] * 500) + "]}}"]
    rows = spark.createDataFrame([(d,) for d in docs], "body string").select(jsonld.nesting(F.col("body")).alias("n")).collect()
    assert [r.n for r in rows] == [1, 4, 0, 0, 4]


def test_jsonld_odd_values(spark):
    docs = [
        {"@type": ["Thing", "MusicEvent"], "name": "A", "startTime": "2026-08-05", "offers": [{"price": 0}], "image": {"url": "/i.png"}},
        {"@type": "Event", "name": "B", "startDate": "2026-08-05", "offers": {"price": 12.5}, "location": "Somewhere"},
        {"@type": "Event", "name": "C", "startDate": "2026-08-05", "offers": {"price": "0"}, "location": [{"name": "L", "address": "Main St"}]},
        {"@type": {"x": "Event"}, "name": "D", "startDate": "2026-08-05"},
        {"@type": "Event", "name": "  ", "startDate": "2026-08-05"},
        {"@type": "Event", "name": "F", "startDate": "someday"},
    ]
    rows = {r.title: r for r in jsonld.jsonld_listings(page(spark, script(docs)), NOW).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert (rows["A"].price_range, rows["A"].image_url) == (None, "https://venue.example/i.png")
    assert (rows["B"].price_range, rows["B"].venue) == ("$12.5", None)
    assert (rows["C"].price_range, rows["C"].venue, rows["C"].city) == ("$0", "L", "Main St")


def test_jsonld_sample_keeps_five(spark):
    docs = [{"@type": "Event", "name": f"N{i}", "startDate": "2026-08-05"} for i in range(9)]
    rows = jsonld.jsonld_sample(jsonld.jsonld_listings(page(spark, script(docs)), NOW)).orderBy("rank").collect()
    assert [(r.title, r.n) for r in rows] == [(f"N{i}", 9) for i in range(5)]


HTML = """<div id="app"><p>skip <article class="card event-card big"><h2> One <b>A&amp;B</b></h2>
<span class="date" datetime="2026-07-04T19:30">soon</span><a href="/x">x</a><a href="/ticket/1">t</a>
<img src="" data-src="/a.png"><em class="price">$5</em></article>
<article class="card"><h3>Two</h3><div><time datetime="2026-07-05"></time></div><a href="/y">y</a></article>
<ul><li class="event">Three<li class="event">Four</ul></div>"""


def items(spark, **sel):
    base = dict(item="article", name="h2, h3", date=".date", ticketLink="a[href*='ticket'], a", image="img", price=".price")
    site = page(spark, HTML).select("*", F.lit("s").alias("source_name"), F.struct(*[
        F.lit(v).alias(k) for k, v in (base | sel).items()]).alias("selectors"))
    return html.html_items(site).orderBy("pos").collect()


def test_html_fields(spark):
    one, two = items(spark)
    assert (one.name, one.date_text, one.link, one.image, one.price) == (" One A&B", "2026-07-04T19:30", "/x", "/a.png", "$5")
    assert (two.name, two.date_text, two.link, two.price) == ("Two", "2026-07-05", "/y", "")


@pytest.mark.parametrize("selector,names", [
    ("#app [class*='event-card'], #app li[class*='event']", 3), (".card.big", 1), ("article.card", 2), ("div article", 2),
    ("ul .event", 2), ("li", 2), ("[data-none]", 0), ("#app .event", 2), ("*[class='event']", 2)])
def test_html_selectors(spark, selector, names):
    assert len(items(spark, item=selector)) == names


def test_html_bad_selectors(spark):
    assert [r.name for r in items(spark, name="h2:first")] == ["", ""]
    (row,) = items(spark, item="article >")
    assert "unsupported selector" in row.error


RSS = """<?xml version="1.0"?><rss><channel><title>F</title>
<item><title>Jazz &amp; Co, Jul 9 at 8pm</title><link>https://f.example/1</link><pubDate>Wed, 01 Jul 2026 12:00:00 GMT</pubDate></item>
<item><title>Quiet night</title><pubDate>Fri, 03 Jul 2026 03:30:00 +0000</pubDate><enclosure url="https://i.example/2.png"/></item>
<item><title>Undated</title></item></channel></rss>"""


def feed(spark, body):
    return spark.createDataFrame([(1, "f", "Feed", "", "Tacoma", None, body)], (
        "id int, source_name string, feed_name string, feed_venue string, feed_city string, feed_category string, body string"))


def test_rss(spark, tmp_path):
    rows = feeds.map_rss(feeds.rss_items(feed(spark, RSS)), NOW, WEST, ["id"]).orderBy("date").collect()
    assert [(r.title, r.date, r.time) for r in rows] == [
        ("Quiet night", dt.date(2026, 7, 2), "20:30"), ("Jazz & Co, Jul 9 at 8pm", dt.date(2026, 7, 9), "20:00")]
    assert rows[0].venue == "Feed" and rows[0].image_url == "https://i.example/2.png" and rows[1].category == "music"
    (tmp_path / "a.xml").write_text(RSS)
    assert feeds.read_rss_items(spark, str(tmp_path)).count() == 3


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link href="https://f.example/"/>
<entry><title type="html">Folk &amp;amp; Co</title><link rel="enclosure" href="https://f.example/e"/><link rel="alternate" href="https://f.example/1"/>
<published>2026-07-03T03:30:00Z</published><updated>2026-07-09T00:00:00Z</updated></entry>
<entry><title>Late set</title><link href="https://f.example/2"/><updated>2026-07-04T20:00:00-07:00</updated></entry></feed>"""


def test_atom(spark):
    rows = feeds.map_rss(feeds.rss_items(feed(spark, ATOM)), NOW, WEST, ["id"]).orderBy("date").collect()
    assert [(r.title, r.ticket_url, r.date, r.time) for r in rows] == [
        ("Folk &amp; Co", "https://f.example/1", dt.date(2026, 7, 2), "20:30"),
        ("Late set", "https://f.example/2", dt.date(2026, 7, 4), "20:00")]


ICAL = ("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Stand-up\\, late\r\n  show\r\nDTSTART;TZID=America/New_York:20260704T230000\r\n"
        "LOCATION:Back\\nroom\r\nURL:https://c.example/1\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260705\r\nEND:VEVENT\r\n"
        "BEGIN:VEVENT\r\nSUMMARY:None\r\nDTSTART;TZID=Nowhere/Land:20260706T100000\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")


def test_ical(spark):
    rows = feeds.map_ical(feeds.ical_events(feed(spark, ICAL)), NOW, WEST, ["id"]).orderBy("date").collect()
    assert [(r.title, r.date, r.time, r.venue) for r in rows] == [
        ("Stand-up, late show", dt.date(2026, 7, 4), "20:00", "Back\nroom"),
        ("Feed", dt.date(2026, 7, 5), "00:00", "Feed"), ("None", dt.date(2026, 7, 6), "10:00", "Feed")]
    assert rows[0].category == "comedy"


def zone(name, *observances):
    parts = [f"BEGIN:{kind}\r\nDTSTART:{start}\r\n" + (f"RRULE:FREQ=YEARLY;{rule}\r\n" if rule else "")
             + f"TZOFFSETFROM:{before}\r\nTZOFFSETTO:{to}\r\nEND:{kind}\r\n" for kind, start, rule, before, to in observances]
    return f"BEGIN:VTIMEZONE\r\nTZID:{name}\r\n{''.join(parts)}END:VTIMEZONE\r\n"


EASTERN = zone("Eastern Standard Time", ("STANDARD", "16011104T020000", "BYDAY=1SU;BYMONTH=11", "-0400", "-0500"),
               ("DAYLIGHT", "16010311T020000", "BYDAY=2SU;BYMONTH=3", "-0500", "-0400"))
LAST = zone("Customized", ("STANDARD", "20001029T030000", "BYMONTH=10;BYDAY=-1SU", "+0200", "+0100"),
            ("DAYLIGHT", "20000326T020000", "BYMONTH=3;BYDAY=-1SU;UNTIL=20250401T000000", "+0100", "+0200"))


@pytest.mark.parametrize("defined,tzid,said,expected", [
    (EASTERN, "Eastern Standard Time", "20260115T200000", "2026-01-15 17:00"),
    (EASTERN, "Eastern Standard Time", "20260704T200000", "2026-07-04 17:00"),
    (EASTERN, "Eastern Standard Time", "20260308T040000", "2026-03-08 00:00"),   # this coast changes three hours later
    (EASTERN, '"Eastern Standard Time"', "20261101T003000", "2026-10-31 21:30"),
    ("", "Eastern Standard Time", "20260704T200000", "2026-07-04 20:00"),
    (LAST, "Customized", "20240401T120000", "2024-04-01 03:00"),
    (LAST, "Customized", "20260701T120000", "2026-07-01 04:00"),                  # no summer time after UNTIL
    (LAST, "Customized", "19990701T120000", "1999-07-01 04:00"),                  # before the first rule: its TZOFFSETFROM
    (zone("X", ("STANDARD", "19700101T000000", "", "+0530", "+0530")), "X", "20260701T120000", "2026-06-30 23:30"),
    (zone("X", ("STANDARD", "bad", "", "x", "y")), "X", "20260701T120000", "2026-07-01 12:00"),
    (EASTERN, "America/New_York", "20260704T200000", "2026-07-04 17:00")])
def test_calendar_zones(spark, defined, tzid, said, expected):
    body = f"BEGIN:VCALENDAR\r\n{defined}BEGIN:VEVENT\r\nSUMMARY:x\r\nDTSTART;TZID={tzid}:{said}\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    events = feeds.ical_events(feed(spark, body))
    (row,) = feeds.map_ical(events, NOW, WEST, ["id"]).collect()
    assert f"{row.date} {row.time}" == expected
    odd = [r.reason for r in feeds.zone_rejects(events, ["id"]).collect()]
    assert odd == ([] if defined or "/" in tzid else ["time zone not known: Eastern Standard Time"])


def test_registry_files(spark, tmp_path):
    doc = {"feeds": [{"id": "a", "name": "A"}, {"id": "b", "name": "B", "enabled": False}, {"id": "c", "enabled": True}]}
    (tmp_path / "feeds.json").write_text(json.dumps(doc, indent=2))
    got = registry.read_registry(spark, str(tmp_path / "feeds.json"), "feeds")
    assert [r.id for r in got.orderBy("id").collect()] == ["a", "c"]
    assert registry.read_registry(spark, str(tmp_path / "none.json"), "scrapers").count() == 0


@pytest.mark.parametrize("url,item,expected", [
    ("https://venue.example/calendar", ".event", None), ("", ".event", "No url"), ("not a url", ".event", "Invalid url"),
    ("file:///etc/passwd", ".event", "scheme"), ("https://v.example", None, "selectors.item"), ("https://v.example", " ", "selectors.item")])
def test_registry_rules(spark, url, item, expected):
    got = spark.range(1).select(registry.violation(F.lit(url), F.lit(item).cast("string"))).first()[0]
    assert got is None if expected is None else expected in got


def test_payload_gaps(spark):
    bodies = ['{"name":"N","dates":{"start":{"localDate":"2026-07-04"}}}', "{broken", '{"name":"no date"}']
    rows = spark.createDataFrame([(i, b, "Seattle") for i, b in enumerate(bodies)], "id int, body string, default_city string")
    (row,) = payloads.map_nested(payloads.parse_payloads(rows, payloads.NESTED), NOW, WEST, ["id"]).collect()
    assert (row.venue, row.city, row.genre_tags, row.image_url, row.price_range, row.time) == (
        "Unknown Venue", "Seattle", "", None, None, None)


def test_best_method_falls_back(spark):
    pages = page(spark, "<title>The Hall - Events</title>")
    row = pg.best_method(pages, NOW).first()
    assert tuple(row)[:5] == (1, "scrape", 0, "https://venue.example/calendar", "scrapers")
    assert (row["id"], row["name"], row["category"], row["sample_title"]) == ("the-hall", "The Hall", "music", None)
    assert json.loads(row["selectors"]) == pg.TEMPLATE
    assert pg.page_site_name(pages).first().site_name == "The Hall"


def scraped(spark, *rows):
    schema = ("page_id long, url string, html string, source_name string, "
              "selectors struct<item: string, name: string, date: string, ticketLink: string, image: string, price: string>")
    full = [(i, "https://x.example/a/", body, "s", sel and (sel, "b", "i", "a", None, None)) for i, (body, sel) in enumerate(rows)]
    return html.html_items(spark.createDataFrame(full, schema))


def test_a_bad_page_never_stops_the_others(spark):
    rows = {r["page_id"]: r["error"] for r in scraped(
        spark, (None, "li"), ("<li><b>A</b>", None), ("<li><b>A</b>", "  "), ("<![foo[ <li><b>A</b>", "li"), ("<li><b>Fine</b>", "li"), ("", "li")).collect()}
    assert rows[0] == "unreadable page: no page text" and rows[1] == rows[2] == "unreadable page: selectors.item is not configured"
    assert rows[4] is None and 5 not in rows


def test_open_items_end_at_the_next(spark):
    rows = scraped(spark, ("<ul><li><p><b>A</b><p>x<li><b>B</b><ul><li><b>C</b></ul><li><b>D</b></ul>", "ul li")).orderBy("pos").collect()
    assert [r["name"] for r in rows] == ["A", "B", "C", "D"]


def test_rejected_items_say_why(spark):
    items = scraped(spark, ("".join(f"<li><b>{n}</b><i>{d}</i></li>" for n, d in [
        ("Good", "2024-01-06"), ("", "2024-01-06"), ("x" * 301, "2024-01-06"), ("No day", "soon"), ("Fifth", "2024-01-07")]), "li"))
    nothing = spark.createDataFrame([], "source_name string, name string, venue string, city string, category string, url string")
    made = html.map_items(items, nothing, dt.date(2024, 1, 10), max_items=4).collect()
    assert [(r["title"], r["venue"]) for r in made] == [("Good", "s")]
    why = {r["pos"]: r["reason"] for r in html.rejected_items(items, dt.date(2024, 1, 10), max_items=4).collect()}
    assert why == {1: "no title", 2: "title too long", 3: "no date", 4: "over the cap"}
    assert html.map_items(items, nothing, dt.date(2024, 1, 10), title_limit=500).count() == 3


def test_feed_items_that_are_not_strict_xml_survive(spark):
    body = ("<rss><item><title>A&nbsp;B</title></item><item><title>C & D</title></item><item><title><![CDATA[E & F]]></title></item>"
            "<item><title>G &amp; H</title></item></rss>")
    docs = spark.createDataFrame([(1, body), (2, None), (3, "gone")], "id long, body string")
    items = feeds.rss_items(docs)
    assert [r["t"] for r in items.select(F.col("item.title").alias("t")).collect()] == ["A\xa0B", "C & D", "E & F", "G & H"]
    rejects = feeds.feed_rejects(docs, items, items.where("item.title LIKE '%&%'"), ["id"]).collect()
    assert sorted(tuple(r) for r in rejects) == [(1, "item without a date"), (2, "unreadable feed"), (3, "unreadable feed")]

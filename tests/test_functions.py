"""Golden rows for the column expressions."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from playbill.functions import dates, text, urls

NOW = dt.date(2026, 7, 2)


def evaluate(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").repartition(2)
    return [r[0] for r in df.select("i", expr(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


D = dt.date
DATES = [
    ("2026-07-04", D(2026, 7, 4)), ("2026-07-04T19:30:00-07:00", D(2026, 7, 4)),
    ("2026-99-99", None), ("2026-02-30", None),
    ("July 4", D(2026, 7, 4)), ("SAT JUL 4", D(2026, 7, 4)), ("Fri, Jul 4th", D(2026, 7, 4)),
    ("Jan 15", D(2027, 1, 15)), ("Jun 25", D(2026, 6, 25)),
    ("Jul 4, 2026", D(2026, 7, 4)), ("4 July 2026", D(2026, 7, 4)),
    ("Fri, 04 Jul 2026 19:00:00 GMT", D(2026, 7, 4)),
    ("7/4/2026", D(2026, 7, 4)), ("07/04/26", D(2026, 7, 4)), ("7/4", D(2026, 7, 4)),
    ("Blink 182", None), ("The 1975", None), ("1975", None), ("An Evening With 311", None),
    ("Jul 4, 1999", None), ("Jul 4, 2099", None), ("", None), (None, None), ("Doors at eight", None),
    # edges of the grace window, leap days, time ranges, ordinals
    ("May 18", D(2026, 5, 18)), ("May 17", D(2027, 5, 17)), ("Feb 29", None), ("Feb 30", None),
    ("6-8 pm", None), ("Sept. 9th", D(2026, 9, 9)), ("13/45", None), ("  2026-07-04  ", D(2026, 7, 4)),
    # last resort
    ("July 2026", D(2026, 7, 1)), ("Summer Fest 2026", D(2026, 1, 1)), ("2026", D(2026, 1, 1)),
    ("2026-08", D(2026, 8, 1)), ("7-4-2026", D(2026, 7, 4)), ("2026 Tour", None),
]


def test_parse_date(spark):
    got = evaluate(spark, [s for s, _ in DATES], lambda c: dates.parse_date(c, NOW))
    assert dict(zip([s for s, _ in DATES], got)) == dict(DATES)


def test_instants_become_local(spark):
    s = ["2026-07-16T02:00:00Z", "2026-07-16T02:00Z", "2026-07-16T02:00:00.000Z", "2026-99-16T02:00:00Z"]
    zone = "America/Los_Angeles"
    assert evaluate(spark, s, lambda c: dates.parse_date(c, NOW, zone)) == [D(2026, 7, 15)] * 3 + [None]
    assert evaluate(spark, s[:3], lambda c: dates.parse_time(c, zone)) == ["19:00"] * 3
    assert evaluate(spark, ["2026-07-04T19:30:00-07:00"], lambda c: dates.parse_time(c, zone)) == ["19:30"]


def test_grace_keeps_clock_time(spark):
    noon = dt.datetime(2026, 7, 2, 12, 0)
    assert evaluate(spark, ["May 18"], lambda c: dates.parse_date(c, noon)) == [D(2027, 5, 18)]


TIMES = [("8 PM", "20:00"), ("8:30pm", "20:30"), ("Doors 7 p.m.", "19:00"), ("12:00 PM", "12:00"),
         ("12 AM", "00:00"), ("2026-07-04T19:30:00", "19:30"), ("19:30", "19:30"),
         ("10 amps of fun", None), ("no time here", None), ("", None), (None, None), ("at 9:05", "09:05")]


def test_parse_time(spark):
    got = evaluate(spark, [s for s, _ in TIMES], dates.parse_time)
    assert got == [e for _, e in TIMES]


def test_classify(spark):
    titles = ["Stand-Up Showcase", "Jazz Night", "Trivia", "Therapy", "Tournament"]
    assert evaluate(spark, titles, text.classify) == ["comedy", "music", "other", "music", "music"]
    assert evaluate(spark, ["Trivia"], lambda c: text.classify(c, "music")) == ["music"]
    assert evaluate(spark, ["Trivia"], lambda c: text.classify(c, None)) == [None]


def test_squash(spark):
    assert evaluate(spark, ["  The\n  Band \t Name ", "a  　b", None], text.squash) == [
        "The Band Name", "a b", ""]


def python_norm(s):
    folded = unicodedata.normalize("NFKD", s.lower())
    kept = "".join(c for c in folded if (c.isascii() and (c.isalnum() or c == "_")) or c.isspace() or c == "﻿")
    return " ".join(kept.replace("﻿", " ").split())


def test_norm_is_exact_nfkd(spark):
    words = ["Café Zoë", "ﬁnd ﬀ", "½ price", "Ångström — №5", "東京", "  A  B ", "①②", "TM™",
             "İstanbul", "straße", "Łódź", "ａｂｃ Ｗ", "a_b-c!", "ẛ̣", "𝔘𝔫𝔦", "x² ㎏"]
    assert evaluate(spark, words, text.norm) == [python_norm(w) for w in words]


def test_slug(spark):
    assert evaluate(spark, ["The Café!", "--a--", "x" * 60], text.slug) == ["the-caf", "-a-"[1:-1], "x" * 40]
    assert evaluate(spark, ["The Café!"], text.slug_loose) == ["the-caf-"]


def test_token_match(spark):
    pairs = [("rock", "indie rock"), ("indie rock", "rock"), ("rock", "rock"), ("", "x"), ("jazz", "rock")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(text.token_match("a", "b")).collect()] == [True, True, True, False, False]


URLS = [
    ("https://venue.example/t/1", "https://venue.example/t/1"), ("javascript:alert(1)", None),
    ("/relative/path", None), (None, None), ("", None), ("HTTP://Venue.Example", "http://venue.example/"),
    ("https://a.example:443/x y", "https://a.example/x%20y"), ("http://a.example:8080?q='z'", "http://a.example:8080/?q=%27z%27"),
    ("  https://a.example/b/../c/./d ", "https://a.example/c/d"), ("https://u:p@H.example/", "https://u:p@h.example/"),
    ("https://", None), ("https://a b.example", None), ("ftp://a.example", None), ("not a url", None),
    ("https://a.example/é#f", "https://a.example/%C3%A9#f"), ("https:\\\\a.example\\b", "https://a.example/b"),
    ("https://a.example/x/..", "https://a.example/"),
]


def test_url_guard(spark):
    got = evaluate(spark, [u for u, _ in URLS], urls.url_guard)
    assert dict(zip([u for u, _ in URLS], got)) == dict(URLS)


RESOLVED = [
    ("/tickets/123", "https://venue.example/tickets/123"), ("javascript:alert(1)", None),
    ("data:text/html,x", None), ("", None), ("//cdn.example/a.png", "https://cdn.example/a.png"),
    ("t/1", "https://venue.example/events/t/1"), ("?p=2", "https://venue.example/events/calendar?p=2"),
    ("#top", "https://venue.example/events/calendar?x=1#top"), ("../up", "https://venue.example/up"),
    ("https://other.example/z", "https://other.example/z"),
]


def test_abs_url(spark):
    base = F.lit("https://venue.example/events/calendar?x=1")
    got = evaluate(spark, [u for u, _ in RESOLVED], lambda c: urls.abs_url(c, base))
    assert dict(zip([u for u, _ in RESOLVED], got)) == dict(RESOLVED)
    assert evaluate(spark, ["https://a.example"], lambda c: urls.abs_url(c, F.lit("nope"))) == [None]


def test_normalize_url_and_host(spark):
    s = ["venue.example", " https://www.Venue.example/a ", "", "bad host.example"]
    assert evaluate(spark, s, urls.normalize_url) == [
        "https://venue.example/", "https://www.venue.example/a", None, None]
    assert evaluate(spark, s[1:2], urls.host_of) == ["venue.example"]


@pytest.mark.parametrize("d,monday,sunday", [
    (D(2024, 1, 10), D(2024, 1, 8), D(2024, 1, 14)), (D(2024, 1, 14), D(2024, 1, 8), D(2024, 1, 14)),
    (D(2024, 1, 8), D(2024, 1, 8), D(2024, 1, 14))])
def test_week_bounds(spark, d, monday, sunday):
    row = spark.range(1).select(dates.week_start(F.lit(d)), dates.week_end(F.lit(d))).first()
    assert tuple(row) == (monday, sunday)


def test_plain_urls_skip_no_rule(spark):
    """URLs the short cut accepts are exactly what the full rules give."""
    s = ["https://a.example/x", "https://a.example/x/", "https://a.example/", "http://a.example/x?y=1&z=%20",
         "https://a.example/.x", "https://a.example/a/../b", "https://a.example", "https://a.example:443/x", "https://a..example/x"]
    df = spark.createDataFrame([(v,) for v in s], "s string")
    rows = df.select(urls.url_guard("s").alias("a"), urls._normal(F.concat("s", F.lit("#"))).alias("b")).collect()
    assert [r.a for r in rows] == [r.b.rstrip("#") for r in rows]

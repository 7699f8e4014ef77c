"""Queries over the scalar rules: dates, times, categories, text, calendar text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from playbill.functions import dates, text, urls
from playbill.plans.registry import query
from playbill.plans.tables import LISTINGS, NOW, listings, read
from playbill.sinks import ics

DAY = dt.date(1999, 7, 2)
WEST = "America/Los_Angeles"


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def classify_sql(expr: str, fallback: str) -> str:
    return (f"CASE WHEN {contains_any(f'lower({expr})', text.COMEDY_HINTS)} THEN 'comedy' "
            f"WHEN {contains_any(f'lower({expr})', text.MUSIC_HINTS)} THEN 'music' ELSE {fallback} END")


def _styled(number, styles):
    out = F.lit(None).cast("string")
    for i, s in enumerate(styles):
        out = F.when(number % len(styles) == i, s).otherwise(out)
    return out


def _date_strings(spark, d):
    """Order dates written in twelve ways."""
    orders = read(spark, d, "orders")
    day = F.col("o_orderdate")

    def shown(pattern):
        return F.date_format(day, pattern)

    styles = [
        shown("yyyy-MM-dd"), F.concat(shown("yyyy-MM-dd"), F.lit("T19:30:00-07:00")), shown("MMM d, yyyy"),
        shown("d MMMM yyyy"), shown("M/d/yyyy"), shown("MM/dd/yy"), F.upper(shown("EEE MMM d")),
        F.concat(F.lit("on "), shown("M/d")), F.lit("Doors at eight"), F.concat(shown("yyyy"), F.lit("-99-99")),
        shown("MMMM yyyy"), F.concat(shown("yyyy-MM-dd"), F.lit("T02:00:00Z"))]
    return orders.select("o_orderkey", _styled(F.col("o_orderkey"), styles).alias("s"))


# The year a day and month without one get, and the date that makes.
INFERRED = """CASE WHEN DATE '1999-01-01' + to_months(CAST(month(o) - 1 AS INTEGER)) + to_days(CAST(day(o) - 1 AS INTEGER))
    < DATE '1999-07-02' - 45 THEN 2000 ELSE 1999 END"""


@query("parse_date", f"""WITH orders_day AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o FROM orders)
  SELECT o_orderkey, CAST(CASE o_orderkey % 12
    WHEN 0 THEN o WHEN 1 THEN o
    WHEN 2 THEN CASE WHEN year(o) BETWEEN 1998 AND 2001 THEN o END
    WHEN 3 THEN CASE WHEN year(o) BETWEEN 1998 AND 2001 THEN o END
    WHEN 4 THEN CASE WHEN year(o) BETWEEN 1998 AND 2001 THEN o END
    WHEN 5 THEN CASE WHEN 2000 + year(o) % 100 BETWEEN 1998 AND 2001
      THEN try_cast((2000 + year(o) % 100) || strftime(o, '-%m-%d') AS DATE) END
    WHEN 6 THEN try_cast({INFERRED} || strftime(o, '-%m-%d') AS DATE)
    WHEN 7 THEN try_cast({INFERRED} || strftime(o, '-%m-%d') AS DATE)
    WHEN 10 THEN CASE WHEN year(o) BETWEEN 1998 AND 2001 THEN date_trunc('month', o) END
    WHEN 11 THEN o - 1 END AS DATE) AS parsed FROM orders_day""")
def _(spark, d):
    return _date_strings(spark, d).select("o_orderkey", dates.parse_date("s", DAY, WEST).alias("parsed"))


@query("parse_time", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN strftime(ts, '%H:00')
    WHEN 2 THEN strftime(ts, '%H:%M') WHEN 3 THEN strftime(ts, '%H:%M') WHEN 4 THEN strftime(ts, '%H:%M')
    WHEN 7 THEN strftime(ts - INTERVAL 8 HOUR, '%H:%M') END AS parsed FROM events""")
def _(spark, d):
    def shown(pattern):
        return F.date_format("ts", pattern)

    half = F.when(F.hour("ts") >= 12, " p.m.").otherwise(" a.m.")
    styles = [shown("h:mm a"), F.lower(shown("ha")), F.concat(F.lit("Doors "), shown("h:mm"), half),
              F.concat(F.lit("from "), shown("HH:mm")), shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("no time here"),
              F.lit("10 amps of fun"), shown("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), shown("HH.mm")]
    return read(spark, d, "events").select(
        "event_id", dates.parse_time(_styled(F.col("event_id"), styles), WEST).alias("parsed"))


@query("infer_year", f"SELECT o_orderkey, CAST({INFERRED} AS INTEGER) AS y FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o FROM orders)")
def _(spark, d):
    return read(spark, d, "orders").select(
        "o_orderkey", dates.infer_year(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), DAY).alias("y"))


@query("plausible_year", "SELECT o_orderkey, year(o_orderdate) BETWEEN 1998 AND 2001 AS ok FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", dates.plausible_year(F.year("o_orderdate"), DAY).alias("ok"))


@query("valid_ymd", """SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate) % 14,
    (day(o_orderdate) + o_orderkey % 5)) AS DATE) AS made FROM orders""")
def _(spark, d):
    made = dates.valid_ymd(F.year("o_orderdate"), F.month("o_orderdate") % 14,
                           F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 5)
    return read(spark, d, "orders").select("o_orderkey", made.alias("made"))


@query("classify", f"SELECT doc_id, {classify_sql('text', 'lang')} AS category FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.classify("text", F.col("lang")).alias("category"))


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x{00a0}]+', ' ', 'g')) AS cleaned FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.squash("text").alias("cleaned"))


@query("local_day", "SELECT event_id, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", dates.local_day(F.col("ts"), WEST).alias("day"))


@query("week_bounds", """SELECT monday, CAST(monday + 6 AS DATE) AS sunday, count(*) AS n FROM (
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS monday FROM lineitem) GROUP BY monday""")
def _(spark, d):
    days = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy(dates.week_start(F.col("day")).alias("monday"), dates.week_end(F.col("day")).alias("sunday")).agg(
        F.sum("n").alias("n"))


@query("normalize_url", r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 3 THEN NULL
    ELSE 'https://' || regexp_replace(url, '^https?://', '') END AS url FROM pages""")
def _(spark, d):
    bare = F.regexp_replace("url", "^https?://", "")
    typed = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" "), F.col("url"), F.lit("\t"))).when(
        F.col("page_id") % 4 == 3, F.concat(F.lit("bad host "), bare)).otherwise(bare)
    return read(spark, d, "pages").select("page_id", urls.normalize_url(typed).alias("url"))


HREFS = r"""hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS href FROM pages)"""


@query("abs_url", f"""WITH {HREFS} SELECT page_id, href, count(*) AS n,
    regexp_extract(any_value(url), '^https?://[^/?#]+') || '/' || array_to_string(list_transform(
      string_split(ltrim(href, '/'), ''), lambda c: CASE WHEN c > chr(127) THEN url_encode(c) ELSE c END), '') AS link
  FROM hrefs GROUP BY page_id, href""")
def _(spark, d):
    from playbill.operators.pages import HREF

    links = read(spark, d, "pages").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "url", "href").agg(F.count("*").alias("n")).select(
        "page_id", "href", "n", urls.abs_url("href", "url").alias("link"))


@query("ics_escape", r"""SELECT doc_id, replace(replace(replace(replace(replace(text || ';\x', '\', '\\'), ';', '\;'), ',', '\,'),
    chr(13) || chr(10), '\n'), chr(10), '\n') AS escaped FROM documents""")
def _(spark, d):
    return read(spark, d, "documents").select(
        "doc_id", ics.ics_escape(F.concat(F.col("text"), F.lit(";\\x"))).alias("escaped"))


STAMP = f"{NOW:%Y%m%dT%H%M%SZ}"


@query("export_ics", f"""WITH {LISTINGS} SELECT id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:listing-' || id || '@localhost',
    'DTSTAMP:{STAMP}', 'DTSTART:' || strftime(event_date, '%Y%m%d') || 'T' || replace(event_time, ':', '') || '00',
    'SUMMARY:' || title, 'LOCATION:' || venue || CASE WHEN city <> '' THEN '\\, ' || city ELSE '' END,
    'DESCRIPTION:' || concat_ws('\\n', 'Artist: ' || nullif(artist, ''), 'Genres: ' || replace(genre_tags, ',', '\\,'),
       'Price: ' || price_range, 'Tickets: ' || ticket_url),
    'URL:' || ticket_url, 'END:VEVENT') AS vevent FROM listings WHERE interested""")
def _(spark, d):
    return ics.ics_rows(listings(spark, d), NOW).select("id", "vevent")


@query("export_ics_allday", f"""WITH {LISTINGS} SELECT 'DTSTART;VALUE=DATE:' || strftime(event_date, '%Y%m%d') AS starts, count(*) AS n
  FROM listings WHERE event_time IS NULL GROUP BY event_date""")
def _(spark, d):
    """Listings without a time, exported as if all were of interest."""
    untimed = listings(spark, d).where(F.col("event_time").isNull()).withColumn("interested", F.lit(True))
    return ics.ics_rows(untimed, NOW).groupBy(
        F.regexp_extract("vevent", r"(?m)^(DTSTART[^\r]*)", 1).alias("starts")).agg(F.count("*").alias("n"))



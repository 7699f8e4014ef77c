"""Source discovery over a table of web pages. Every step is map-only per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf
from playbill.functions.text import let, slug, squash
from playbill.functions.urls import abs_url, host_of
from playbill.sources.jsonld import page_summary

# Link patterns, common feed paths and ticketing providers.
LINK_TAG = r"(?i)<link\b[^>]*>"
HREF = r"(?i)href=[\"']([^\"']+)[\"']"
TYPE = r"(?i)type=[\"']([^\"']+)[\"']"
FEED_TYPE = r"(?i)application/(rss|atom)\+xml"
CALENDAR_TYPE = r"(?i)text/calendar"
CALENDAR_HREF = r"(?i)\.ics(\?|$)"
WEBCAL = r"(?i)^webcal:"
FEED_HREF = r"(?i)/(feed|rss)(/|$|\?)"
RSS_PATHS = ["/feed", "/feed/", "/rss", "/rss/", "/events/feed/", "/?feed=rss2", "/feed/rss"]
ICAL_PATHS = ["/events.ics", "/calendar.ics", "/events/feed/ical", "/?ical=1"]
PROVIDERS = [
    ("eventbrite", "eventbrite.com"), ("bandsintown", "bandsintown.com"), ("songkick", "songkick.com"),
    ("ticketmaster", "ticketmaster.com"), ("dice", "dice.fm"), ("seetickets", "seetickets."),
    ("ticketweb", "ticketweb."), ("prekindle", "prekindle.com"), ("axs", "axs.com"),
]
SITE_NAME = r"(?i)property=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']+)[\"']"
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"
# The fallback scraper template.
TEMPLATE = {
    "item": ".event, article, .eventlist-event", "name": ".event-title, .eventlist-title, h2, h3",
    "date": "time, .event-date, .eventlist-meta-date", "ticketLink": "a[href*='ticket'], a", "image": "img", "price": ".price",
}

FOUND = "array<struct<kind: string, href: string>>"


def _found(kind: str, href: Column, when: Column) -> Column:
    return F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), href.alias("href")))).otherwise(
        F.array().cast(FOUND))


def _links(html: Column) -> Column:
    """(kind, href) of link tags, then of all hrefs, in page order."""
    def of_tag(tag: Column) -> Column:
        kind, href = F.regexp_extract(tag, TYPE, 1), F.regexp_extract(tag, HREF, 1)
        return F.concat(
            _found("rss", href, (href != "") & kind.rlike(FEED_TYPE)),
            _found("ical", href, (href != "") & (kind.rlike(CALENDAR_TYPE) | href.rlike(CALENDAR_HREF))))

    def of_href(href: Column) -> Column:
        return F.concat(
            _found("ical", F.regexp_replace(href, WEBCAL, "https:"), href.rlike(CALENDAR_HREF) | href.rlike(WEBCAL)),
            _found("rss", href, href.rlike(FEED_HREF) & ~href.rlike("(?i)comment")))

    tags = F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0))
    hrefs = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.concat(F.flatten(F.transform(tags, of_tag)), F.flatten(F.transform(hrefs, of_href)))


def _resolved(html: Column, url: Column) -> Column:
    """Distinct (kind, url) found on the page, first occurrence first."""
    absolute = F.transform(_links(html), lambda x: F.struct(x["kind"].alias("kind"), abs_url(x["href"], url).alias("url")))
    return F.array_distinct(F.filter(absolute, lambda x: x["url"].isNotNull()))


def page_feed_links(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.posexplode(_resolved(F.col("html"), F.col("url"))).alias("place", "f"))
    return rows.select("page_id", "place", "f.*")


def feed_candidates(pages: DataFrame) -> DataFrame:
    """URLs to try per page and kind: found links first, then common paths."""
    def kind(name: str, paths: list[str]) -> Column:
        mine = F.transform(F.filter("found", lambda f: f["kind"] == name), lambda f: f["url"])
        guesses = F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: abs_url(p, F.col("url")))
        return F.transform(F.concat(mine, guesses), lambda u, i: F.struct(
            F.lit(name).alias("kind"), i.alias("rank"), u.alias("candidate")))

    found = pages.select("page_id", "url", _resolved(F.col("html"), F.col("url")).alias("found"))
    rows = found.select("page_id", F.explode(F.concat(kind("rss", RSS_PATHS), kind("ical", ICAL_PATHS))).alias("c"))
    return rows.select("page_id", "c.*")


def page_providers(pages: DataFrame) -> DataFrame:
    """Ticketing providers each page mentions, in table order."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("needle")) for n, w in PROVIDERS])
    named = let(F.lower("html"), lambda page: F.transform(
        F.filter(table, lambda p: F.contains(page, p["needle"])), lambda p: p["name"]))
    return pages.select("page_id", F.array_join(named, ",").alias("providers"))


def site_name(html: Column, url: Column) -> Column:
    """og:site_name, else the title up to its first separator, else the host."""
    og, title = F.regexp_extract(html, SITE_NAME, 1), F.regexp_extract(html, TITLE, 1)
    return (F.when(og != "", squash(og))
            .when(title != "", F.trim(F.get(F.split(squash(title), r"[|\-–—:]"), F.lit(0))))
            .otherwise(F.coalesce(host_of(url), url)))


def page_site_name(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", site_name(F.col("html"), F.col("url")).alias("site_name"))


def page_slug(pages: DataFrame) -> DataFrame:
    """Source id of each page: slug of its name, else of its host name."""
    host = F.regexp_extract(F.col("url"), r"^https?://([^/?#:]*)", 1)
    named = pages.select("page_id", slug(site_name(F.col("html"), F.col("url"))).alias("slug"), slug(host).alias("other"))
    return named.select("page_id", F.when(F.col("slug") != "", F.col("slug")).otherwise(F.col("other")).alias("slug"))


def page_link_counts(pages: DataFrame) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return pages.select("page_id", F.size(hrefs).alias("n_links"), F.size(F.array_distinct(hrefs)).alias("n_distinct"))


def best_method(pages: DataFrame, as_of: AsOf, zone: str = "UTC") -> DataFrame:
    """Recommended ingestion per page: rss, ical, jsonld, else a scraper template, with the registry entry to add.

    A feed counts as present when the page links to one. The page text is read once: link counts, name and
    JSON-LD listings come from the same row, and only they are shuffled. ``selectors`` is the template of
    the scrape case, as JSON; ``sample_title`` is the page's first listing.
    """
    html, url = F.col("html"), F.col("url")
    host = F.regexp_extract(url, r"^https?://([^/?#:]*)", 1)
    name = site_name(html, url)
    found = page_summary(pages, as_of, zone, {
        "f": let(_resolved(html, url), lambda f: F.struct(
            F.size(F.filter(f, lambda x: x["kind"] == "rss")).alias("rss"),
            F.size(F.filter(f, lambda x: x["kind"] == "ical")).alias("ical"),
            F.get(F.filter(f, lambda x: x["kind"] == "rss"), F.lit(0))["url"].alias("rss_url"),
            F.get(F.filter(f, lambda x: x["kind"] == "ical"), F.lit(0))["url"].alias("ical_url"))),
        "name": name, "slug": slug(name), "host_slug": slug(host)})
    rss, ical, ld = F.col("f.rss"), F.col("f.ical"), F.col("n").cast("int")
    scrape = (rss + ical + ld) == 0
    return found.select(
        "page_id",
        F.when(rss > 0, "rss").when(ical > 0, "ical").when(ld > 0, "jsonld").otherwise("scrape").alias("method"),
        F.when(rss > 0, rss).when(ical > 0, ical).when(ld > 0, ld).otherwise(0).alias("sample_count"),
        F.when(rss > 0, F.col("f.rss_url")).when(ical > 0, F.col("f.ical_url")).otherwise(F.col("url")).alias("source_url"),
        F.when(scrape, "scrapers").otherwise("feeds").alias("target"),
        F.when(F.col("slug") != "", F.col("slug")).otherwise(F.col("host_slug")).alias("id"), "name",
        F.lit("music").alias("category"), F.when(scrape, F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in TEMPLATE.items()]))).alias("selectors"),
        F.get("sample", F.lit(0))["title"].alias("sample_title"))

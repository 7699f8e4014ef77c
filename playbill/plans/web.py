"""Queries over pages, feeds, payloads and registries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from playbill.functions.text import slug, slug_loose
from playbill.operators import ingest
from playbill.operators import pages as pg
from playbill.operators import refresh as rf
from playbill.operators import runs as rn
from playbill.operators.ingest import normalize, upsert
from playbill.plans.parsing import HREFS, WEST, classify_sql
from playbill.plans.registry import query
from playbill.plans.tables import AS_OF, SHOWS, _pick, norm_sql, ntz, read, shows
from playbill.session import stored, work_folder
from playbill.sources import feeds as fd
from playbill.sources import html as ht
from playbill.sources import jsonld as jl
from playbill.sources import payloads as pl
from playbill.sources import registry as rg


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _if(condition, *parts):
    return F.when(condition, _text(*parts)).otherwise("")


# ── pages with feed links, names, providers, JSON-LD and event markup ──────

def _event_json(i):
    """JSON-LD of the i-th event of a page."""
    return _text(
        '{"@type":', F.when(i % 2 == 1, '["Thing","ComedyEvent"]').otherwise('"Event"'),
        ',"name":"', F.when(i == 3, "").otherwise(_text(" Show  ", i, " ")),
        '","startDate":"2024-01-', F.lpad((i + 5).cast("string"), 2, "0"), 'T20:00:00-08:00"',
        ',"location":[{"name":"Hall","address":{"addressLocality":"Tacoma"}}],"offers":{"price":', i * 5,
        ',"url":"/t/', i, '"},"image":["/img/', i, '.png"],"performer":{"name":"Act ', i, '"},"doorTime":"7 PM"}')


def _item_html(i):
    """Markup of the i-th event of a page; every third one has a text date."""
    when = F.when(i % 3 == 0, '<p class="when">SAT JAN 6 8 PM</p>').otherwise(_text(
        '<time datetime="2024-01-', F.lpad((i % 28 + 1).cast("string"), 2, "0"), 'T19:30">soon</time>'))
    return _text('<li class="pb-event n', i, '"><h3><a href="/tickets/', i, '">  Show &amp; ', i, ' <b>Live</b></a></h3>',
                 when, '<img data-src="//img.example/', i, '.png"><span class="price"> $', i, ' </span></li>')


def _listed(n, fn, between):
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), fn), between)


def rich_pages(spark, d):
    """The given pages with listing features written in front of their markup."""
    n = F.col("page_id")
    script = '<script type="application/ld+json">'
    count = (n % 4 + 1).cast("int")
    items = F.when(n % 50 == 0, 260).otherwise(n % 6 + 1).cast("int")
    head = F.concat(
        _if(n % 3 == 0, '<link rel="alternate" type="application/rss+xml" href="/', n, '/feed.xml">'),
        _if(n % 4 == 0, '<LINK type="text/calendar" href="/cal-', n, '.ics?x=1">'),
        _if(n % 5 == 0, '<a href="webcal://cal.example/', n, '.ics">c</a>'),
        _if(n % 2 == 0, '<a href="/blog/feed/">f</a><a href="/comments/feed">c</a>'),
        _if(n % 7 == 0, '<a href="javascript:x.ics">j</a>'),
        _if(n % 6 == 0, '<meta property="og:site_name" content=" Site   ', n, ' ">'),
        _if(n % 11 == 0, '<title></title>'),
        _if(n % 8 == 1, 'at https://www.Eventbrite.com/e/1 '), _if(n % 9 == 2, 'on https://dice.fm/x '),
        _if(n % 3 == 1, script, '{"@type":"Place","name":"Hall","Events":[', _listed(count, _event_json, ","), ']}</script>',
            script, '{"@graph":[{"x":{"y":[{"@type":"MusicEvent","name":"Deep","startTime":"2024-01-09"}]}}]}</script>'),
        _if(n % 2 == 1, script, '{"@type":"Event", broken</script>'),
        _text("<ul>"), _listed(items, _item_html, ""), _text("</ul>"))
    return read(spark, d, "pages").withColumn("html", F.concat(head, "html"))


ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"
FOUND_RSS = f"""list_filter([CASE WHEN page_id % 3 = 0 THEN {ORIGIN} || '/' || page_id || '/feed.xml' END,
    CASE WHEN page_id % 2 = 0 THEN {ORIGIN} || '/blog/feed/' END], lambda x: x IS NOT NULL)"""
FOUND_ICAL = f"""list_filter([CASE WHEN page_id % 4 = 0 THEN {ORIGIN} || '/cal-' || page_id || '.ics?x=1' END,
    CASE WHEN page_id % 5 = 0 THEN 'https://cal.example/' || page_id || '.ics' END], lambda x: x IS NOT NULL)"""


@query("page_feed_links", f"""SELECT page_id, 'rss' AS kind, unnest({FOUND_RSS}) AS url FROM pages
  UNION ALL SELECT page_id, 'ical', unnest({FOUND_ICAL}) FROM pages""")
def _(spark, d):
    return pg.page_feed_links(rich_pages(spark, d)).select("page_id", "kind", "url")


def _paths(paths):
    return "[" + ", ".join(f"{ORIGIN} || '{p}'" for p in paths) + "]"


@query("feed_candidates", f"""WITH c AS (
    SELECT page_id, 'rss' AS kind, {FOUND_RSS} || {_paths(pg.RSS_PATHS)} AS l FROM pages
    UNION ALL SELECT page_id, 'ical', {FOUND_ICAL} || {_paths(pg.ICAL_PATHS)} FROM pages)
  SELECT page_id, kind, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS rank, unnest(l) AS candidate FROM c""")
def _(spark, d):
    return pg.feed_candidates(rich_pages(spark, d))


@query("page_providers", """SELECT page_id, concat_ws(',', CASE WHEN page_id % 8 = 1 THEN 'eventbrite' END,
    CASE WHEN page_id % 9 = 2 THEN 'dice' END) AS providers FROM pages""")
def _(spark, d):
    return pg.page_providers(rich_pages(spark, d))


PAGE_TITLE = r"""trim(regexp_extract(trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1), '\s+', ' ', 'g')),
    '^[^|\-–—:]*'))"""
PAGE_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
SITE = f"""CASE WHEN page_id % 6 = 0 THEN 'Site ' || page_id WHEN page_id % 11 = 0 THEN regexp_replace({PAGE_HOST}, '^www\\.', '')
    ELSE {PAGE_TITLE} END"""


@query("page_site_name", f"SELECT page_id, {SITE} AS site_name FROM pages")
def _(spark, d):
    return pg.page_site_name(rich_pages(spark, d))


def slug_sql(e):
    return f"left(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40)"


@query("slug", f"""SELECT page_id, CASE WHEN {slug_sql(SITE)} <> '' THEN {slug_sql(SITE)} ELSE {slug_sql(PAGE_HOST)} END AS slug FROM pages""")
def _(spark, d):
    return pg.page_slug(rich_pages(spark, d))


@query("slug_texts", f"SELECT doc_id, {slug_sql('text')} AS slug, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g') AS loose FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", slug("text").alias("slug"), slug_loose("text").alias("loose"))


@query("page_link_counts", f"""WITH {HREFS} SELECT p.page_id, CAST(count(h.href) AS INTEGER) AS n_links,
  CAST(count(DISTINCT h.href) AS INTEGER) AS n_distinct FROM pages p LEFT JOIN hrefs h USING (page_id) GROUP BY p.page_id""")
def _(spark, d):
    return pg.page_link_counts(read(spark, d, "pages"))


# Events of a page: its Place lists page_id % 4 + 1 of them (the fourth has no name), its graph one more.
LD = """ld AS (SELECT * FROM (SELECT page_id, url, unnest(generate_series(0, page_id % 4)) AS i FROM pages WHERE page_id % 3 = 1) WHERE i <> 3
  UNION ALL SELECT page_id, url, -1 FROM pages WHERE page_id % 3 = 1)"""


@query("best_method", f"""WITH {LD}, n AS (SELECT page_id, count(*) AS events FROM ld GROUP BY page_id), c AS (
    SELECT page_id, url, {FOUND_RSS} AS r, {FOUND_ICAL} AS i, coalesce(events, 0) AS events,
      {SITE} AS site, {PAGE_HOST} AS host FROM pages LEFT JOIN n USING (page_id))
  SELECT page_id, CASE WHEN len(r) > 0 THEN 'rss' WHEN len(i) > 0 THEN 'ical' WHEN events > 0 THEN 'jsonld' ELSE 'scrape' END AS method,
    CAST(CASE WHEN len(r) > 0 THEN len(r) WHEN len(i) > 0 THEN len(i) ELSE events END AS INTEGER) AS sample_count,
    CASE WHEN len(r) > 0 THEN r[1] WHEN len(i) > 0 THEN i[1] ELSE url END AS source_url,
    CASE WHEN len(r) + len(i) + events = 0 THEN 'scrapers' ELSE 'feeds' END AS target,
    CASE WHEN {slug_sql('site')} <> '' THEN {slug_sql('site')} ELSE {slug_sql('host')} END AS id, site AS name, 'music' AS category,
    CASE WHEN len(r) + len(i) + events = 0 THEN '{json.dumps(pg.TEMPLATE, separators=(",", ":")).replace("'", "''")}' END AS selectors,
    CASE WHEN events > 0 THEN 'Show 0' END AS sample_title FROM c""")
def _(spark, d):
    return pg.best_method(rich_pages(spark, d), AS_OF)


@query("jsonld_blocks", """SELECT page_id, block, 6 AS depth, ['Hall', 'Deep'][block + 1] AS name
  FROM (SELECT page_id, unnest([0, 1]) AS block FROM pages WHERE page_id % 3 = 1)""")
def _(spark, d):
    """Blocks that can be read, with their depth and the name of a node inside."""
    name = F.coalesce(*[F.try_variant_get("doc", p, "string") for p in ("$.name", "$['@graph'][0].x.y[0].name")])
    return jl.jsonld_blocks(rich_pages(spark, d)).select("page_id", "block", "depth", name.alias("name"))


def deep_pages(spark, d):
    """A page for each given one, whose event stands inside ``page_id % 50`` objects and as many arrays."""
    n = (F.col("page_id") % 50).cast("int")
    doc = _text(F.repeat(F.lit('{"x":['), n), '{"@type":"Event","name":"Level ', n, '","note":"[[{{\\\\\\"["}', F.repeat(F.lit("]}"), n))
    return read(spark, d, "pages").select("page_id", "url", _text('<script type="application/ld+json">', doc, "</script>").alias("html"))


@query("jsonld_event_nodes", """SELECT page_id, 0 AS block, i AS place, CASE WHEN i = 3 THEN '' ELSE ' Show  ' || i || ' ' END AS name, '1,' || i AS path FROM (
    SELECT page_id, CAST(unnest(generate_series(0, page_id % 4)) AS INTEGER) AS i FROM pages WHERE page_id % 3 = 1)
  UNION ALL SELECT page_id, 1, 0, 'Deep', '0,0,0,0,0' FROM pages WHERE page_id % 3 = 1
  UNION ALL SELECT page_id, 9, 0, 'Level ' || (page_id % 50), array_to_string(list_transform(range(2 * (page_id % 50)), lambda x: 0), ',') FROM pages""")
def _(spark, d):
    """Events by name and path, of listing pages and of pages that hide theirs up to 98 levels deep."""
    told = ["page_id", "block", "place", F.try_variant_get("node", "$.name", "string").alias("name"), F.array_join(F.col("path").cast("array<string>"), ",").alias("path")]
    deep = jl.jsonld_blocks(deep_pages(spark, d)).withColumn("block", F.lit(9))
    return jl.jsonld_event_nodes(jl.jsonld_blocks(rich_pages(spark, d))).select(*told).unionByName(jl.jsonld_event_nodes(deep).select(*told))


@query("jsonld_truncated", """SELECT page_id, 0 AS block, 'truncated: nested ' || (2 * (page_id % 50) + 1) || ' deep, searched to 12' AS reason
  FROM pages WHERE 2 * (page_id % 50) > 12""")
def _(spark, d):
    """What a caller's limit of 12 levels leaves out."""
    return jl.truncated_blocks(jl.jsonld_blocks(deep_pages(spark, d)), 12).select("page_id", "block", "reason")


@query("jsonld_to_listing", f"""WITH {LD} SELECT page_id, CASE WHEN i < 0 THEN 'Deep' ELSE 'Show ' || i END AS title,
    CASE WHEN i >= 0 THEN 'Act ' || i END AS artist, CASE WHEN i >= 0 THEN 'Hall' END AS venue, CASE WHEN i >= 0 THEN 'Tacoma' END AS city,
    CASE WHEN i < 0 THEN DATE '2024-01-09' ELSE CAST(DATE '2024-01-05' + CAST(i AS INTEGER) AS DATE) END AS date,
    CASE WHEN i >= 0 THEN '20:00' END AS time, CASE WHEN i >= 0 THEN '19:00' END AS doors_time,
    CASE WHEN i < 0 THEN 'music' WHEN i % 2 = 1 THEN 'comedy' END AS category,
    CASE WHEN i >= 0 THEN {ORIGIN} || '/t/' || i END AS ticket_url,
    CASE WHEN i >= 0 THEN {ORIGIN} || '/img/' || i || '.png' END AS image_url,
    CASE WHEN i > 0 THEN '$' || (i * 5) END AS price_range FROM ld""")
def _(spark, d):
    return jl.jsonld_listings(rich_pages(spark, d), AS_OF, WEST).drop("block", "place", "genre_tags")


@query("jsonld_sample", f"""WITH {LD} SELECT page_id, CAST(CASE WHEN i < 0 THEN count(*) OVER (PARTITION BY page_id) ELSE i + 1 END AS INTEGER) AS rank,
    CASE WHEN i < 0 THEN 'Deep' ELSE 'Show ' || i END AS title,
    CASE WHEN i < 0 THEN DATE '2024-01-09' ELSE CAST(DATE '2024-01-05' + CAST(i AS INTEGER) AS DATE) END AS date,
    count(*) OVER (PARTITION BY page_id) AS n FROM ld""")
def _(spark, d):
    return jl.jsonld_sample(jl.jsonld_listings(rich_pages(spark, d), AS_OF))


# ── scraped items ──────────────────────────────────────────────────────────

def _scraped(spark, d):
    """Pages with the registry entry of the site they belong to."""
    site = F.col("page_id") % 5
    selectors = F.struct(
        F.when(site % 2 == 0, ".pb-event").otherwise("ul li[class*='pb-event']").alias("item"),
        F.when(site == 3, "h3:bad").otherwise("h3 a, h3").alias("name"), F.lit("time, .when").alias("date"),
        F.lit("a[href*='ticket'], a").alias("ticketLink"), F.lit("img").alias("image"), F.lit(".price").alias("price"))
    return rich_pages(spark, d).select(
        "page_id", "url", "html", _text("site", site).alias("source_name"), selectors.alias("selectors"))


def _sites(spark, d):
    """One registry entry per nation: the sites that pages may belong to."""
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(
        _text("site", n).alias("source_name"), F.col("n_name").alias("name"),
        F.when(n % 2 == 0, _text("Hall ", n)).alias("venue"), F.lit("").alias("city"),
        F.when(n % 3 == 0, "comedy").alias("category"), _text("https://site", n, ".example/calendar/").alias("url"))


ITEMS = """items AS (
  SELECT page_id, CAST(i AS INTEGER) AS pos, i, page_id % 5 AS site FROM (
    SELECT page_id, unnest(generate_series(0, CASE WHEN page_id % 50 = 0 THEN 259 ELSE page_id % 6 END)) AS i FROM pages))"""
ITEM_DATE = "CASE WHEN i % 3 = 0 THEN 'SAT JAN 6 8 PM' ELSE '2024-01-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || 'T19:30' END"


@query("html_items", f"""WITH {ITEMS} SELECT page_id, 'site' || site AS source_name, pos,
    CASE WHEN site = 3 THEN '' ELSE '  Show & ' || i || ' Live' END AS name, {ITEM_DATE} AS date_text,
    '/tickets/' || i AS link, '//img.example/' || i || '.png' AS image, ' $' || i || ' ' AS price FROM items""")
def _(spark, d):
    return ht.html_items(_scraped(spark, d)).drop("url", "error")


@query("html_item_cap", f"""WITH {ITEMS} SELECT page_id, CAST(n_nationkey AS BIGINT) AS site, pos, 'Show & ' || i || ' Live' AS title,
    CASE WHEN n_nationkey % 2 = 0 THEN 'Hall ' || n_nationkey ELSE n_name END AS venue,
    CASE WHEN i % 3 = 0 THEN DATE '2024-01-06' ELSE CAST(DATE '2024-01-01' + CAST(i % 28 AS INTEGER) AS DATE) END AS date,
    CASE WHEN i % 3 = 0 THEN '20:00' ELSE '19:30' END AS time, CASE WHEN n_nationkey % 3 = 0 THEN 'comedy' ELSE 'music' END AS category,
    'https://site' || n_nationkey || '.example/tickets/' || i AS ticket_url, 'https://img.example/' || i || '.png' AS image_url,
    '$' || i AS price_range
  FROM items JOIN nation ON n_nationkey = site WHERE site <> 3 AND pos < 250""")
def _(spark, d):
    items = ht.html_items(_scraped(spark, d))
    return ht.map_items(items, _sites(spark, d), AS_OF, max_items=ht.MAX_ITEMS).select(
        "page_id", F.substring("source_name", 5, 9).cast("long").alias("site"), "pos", "title", "venue", "date", "time",
        "category", "ticket_url", "image_url", "price_range")


# ── registries ─────────────────────────────────────────────────────────────

def _registry_documents(spark, d):
    """One registry document per supplier, as text: an enabled, a disabled and an unmarked feed."""
    def feed(suffix, enabled):
        return F.struct(F.concat("s_name", F.lit(suffix)).alias("id"), F.col("s_name").alias("name"),
                        enabled.alias("enabled"))

    on, off, unset = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    body = F.to_json(F.struct(F.array(feed("-a", on), feed("-b", off), feed("-c", unset)).alias("feeds")))
    return read(spark, d, "supplier").select(F.from_json(body, rg.document_schema("feeds")).alias("doc")).select("doc.*")


@query("src_registry", """SELECT s_name || unnest(['-a', '-c']) AS id, s_name AS name FROM supplier""")
def _(spark, d):
    return rg.enabled(_registry_documents(spark, d), "feeds").select("id", "name")


@query("registry_violations", """WITH r AS (SELECT *, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'not a url' WHEN 2 THEN 'file:///etc/' || s_suppkey
    WHEN 3 THEN 'https://' ELSE 'https://ok.example/' || s_suppkey END AS url FROM supplier)
  SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'No url configured' WHEN 1 THEN 'Invalid url "not a url"'
    WHEN 2 THEN 'Unsupported URL scheme "file:" — only http(s) is scraped' WHEN 3 THEN 'Invalid url "https://"'
    ELSE CASE WHEN s_nationkey % 2 = 0 THEN 'selectors.item is not configured — set it to the repeating per-event element' END END AS violation
  FROM r""")
def _(spark, d):
    n = F.col("s_suppkey")
    url = (F.when(n % 6 == 0, "").when(n % 6 == 1, "not a url").when(n % 6 == 2, _text("file:///etc/", n))
           .when(n % 6 == 3, "https://").otherwise(_text("https://ok.example/", n)))
    item = F.when(F.col("s_nationkey") % 4 == 0, "  ").when(F.col("s_nationkey") % 2 == 1, ".event")
    return read(spark, d, "supplier").select("s_suppkey", rg.violation(url, item).alias("violation"))


@query("source_defaults", """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'N' THEN 'Hall' WHEN s_nationkey % 2 = 0 THEN 'Room ' || s_nationkey ELSE s_name END AS venue,
    CASE WHEN l_linestatus = 'F' THEN 'Town' WHEN s_nationkey % 5 <> 0 THEN 'City ' || s_nationkey END AS city,
    CASE WHEN l_linenumber = 1 THEN 'comedy' WHEN s_nationkey % 3 = 0 THEN 'other' ELSE 'music' END AS category,
    CASE WHEN s_nationkey % 3 = 0 THEN 'other' ELSE 'tag' END AS genre_tags
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def _(spark, d):
    n = F.col("s_nationkey")
    registry = read(spark, d, "supplier").select(
        _text("s", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.when(n % 2 == 0, _text("Room ", n)).alias("venue"),
        F.when(n % 5 == 0, "").otherwise(_text("City ", n)).alias("city"), F.when(n % 3 == 0, "other").alias("category"))
    batch = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", _text("s", F.col("l_suppkey")).alias("source_name"),
        F.when(F.col("l_returnflag") == "N", "Hall").when(F.col("l_returnflag") == "A", "").alias("venue"),
        F.when(F.col("l_linestatus") == "F", "Town").otherwise("").alias("city"),
        F.when(F.col("l_linenumber") == 1, "comedy").alias("category"), F.lit("tag").alias("genre_tags"))
    return ingest.source_defaults(batch, registry).drop("source_name")


# ── API payloads ───────────────────────────────────────────────────────────

def _payloads(spark, d, body, *extra):
    """Payload text per show, read back the way a landed file is."""
    return shows(spark, d).select("event_id", body.alias("body"), *extra)


LOCAL = "ts - INTERVAL 8 HOUR"


@query("map_api_nested", f"""WITH {SHOWS} SELECT event_id, p_name AS title, CASE WHEN user_id % 5 <> 0 THEN p_brand END AS artist,
    CASE WHEN user_id % 7 = 0 THEN 'Unknown Venue' ELSE n_name END AS venue, CASE WHEN user_id % 7 = 0 THEN 'Seattle' ELSE r_name END AS city,
    CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time,
    {classify_sql("CASE WHEN p_type = 'SMALL' THEN 'Comedy' ELSE 'Arts' END || ' ' || lower(p_type) || CASE WHEN user_id % 2 = 0 THEN '' ELSE ' ' || lower(p_brand) END", "'music'")} AS category,
    lower(p_type) || CASE WHEN user_id % 2 = 0 THEN '' ELSE ', ' || lower(p_brand) END AS genre_tags,
    CASE WHEN p_size >= 25 THEN 'https://img.example/a' ELSE 'https://img.example/b' END AS image_url,
    CASE WHEN user_id % 3 = 0 THEN '$' || p_size || '–$99' END AS price_range
  FROM shows WHERE event_type <> 'error'""")
def _(spark, d):
    user = F.col("user_id")
    named = lambda c: F.struct(c.alias("name"))
    body = F.to_json(F.struct(
        F.col("p_name").alias("name"), F.lit("https://t.example/").alias("url"),
        F.struct(F.struct(
            F.when(F.col("event_type") == "error", "TBA").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("localDate"),
            F.date_format("ts", "HH:mm:ss").alias("localTime")).alias("start")).alias("dates"),
        F.array(F.struct(F.lit("https://img.example/a").alias("url"), F.col("p_size").alias("width")),
                F.struct(F.lit("https://img.example/b").alias("url"), F.lit(25).alias("width")),
                F.struct(F.lit(None).cast("string").alias("url"), F.lit(99).alias("width"))).alias("images"),
        F.when(user % 3 == 0, F.array(F.struct(F.col("p_size").alias("min"), F.lit(99).alias("max")))).alias("priceRanges"),
        F.array(F.struct(named(F.when(F.col("p_type") == "SMALL", "Comedy").otherwise("Arts")).alias("segment"),
                         named(F.col("p_type")).alias("genre"),
                         named(F.when(user % 2 == 0, "Undefined").otherwise(F.col("p_brand"))).alias("subGenre"))).alias("classifications"),
        F.struct(
            F.when(user % 7 == 0, F.array().cast("array<struct<name:string,city:struct<name:string>>>")).otherwise(
                F.array(F.struct(F.col("n_name").alias("name"), named(F.col("r_name")).alias("city")))).alias("venues"),
            F.when(user % 5 != 0, F.array(named(F.col("p_brand")))).alias("attractions")).alias("_embedded")))
    rows = pl.parse_payloads(_payloads(spark, d, body, F.lit("Seattle").alias("default_city")), pl.NESTED)
    return pl.map_nested(rows, AS_OF, WEST, ["event_id"]).select(
        "event_id", "title", "artist", "venue", "city", "date", "time", "category", "genre_tags", "image_url", "price_range")


@query("map_api_flat", f"""WITH {SHOWS} SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'Untitled' ELSE p_name END AS title, n_name AS venue,
    CASE WHEN user_id % 6 = 0 THEN 'Tacoma' ELSE r_name END AS city,
    CAST(CASE WHEN user_id % 2 = 0 THEN {LOCAL} ELSE ts END AS DATE) AS date,
    strftime(CASE WHEN user_id % 2 = 0 THEN {LOCAL} ELSE ts END, '%H:%M') AS time,
    CASE WHEN user_id % 4 = 0 THEN 'comedy' ELSE 'music' END AS category, CASE WHEN user_id % 4 = 0 THEN 'comedy' ELSE 'music' END AS genre_tags,
    CASE WHEN user_id % 3 = 0 THEN 'Free' END AS price_range FROM shows""")
def _(spark, d):
    user = F.col("user_id")
    body = F.to_json(F.struct(
        F.struct(F.when(user % 9 != 0, F.col("p_name")).alias("text")).alias("name"),
        (user % 3 == 0).alias("is_free"),
        F.struct(F.when(user % 2 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("local"),
                 F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("start"),
        F.struct(F.col("n_name").alias("name"), F.struct(F.when(user % 6 != 0, F.col("r_name")).alias("city")).alias("address")).alias("venue")))
    rows = pl.parse_payloads(_payloads(
        spark, d, body, F.when(user % 4 == 0, "comedy").otherwise("music").alias("category"),
        F.lit("Tacoma").alias("default_city")), pl.FLAT)
    return pl.map_flat(rows, AS_OF, WEST, ["event_id"]).select(
        "event_id", "title", "venue", "city", "date", "time", "category", "genre_tags", "price_range")


@query("map_api_region", f"""WITH {SHOWS} SELECT event_id, CASE WHEN user_id % 4 = 0 THEN p_brand ELSE p_name END AS title, p_brand AS artist,
    n_name AS venue, r_name AS city, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time,
    CASE WHEN user_id % 2 = 0 THEN 'https://o.example/' || event_id ELSE 'https://e.example/' END AS ticket_url
  FROM shows WHERE user_id % 3 < 2""")
def _(spark, d):
    user = F.col("user_id")
    body = F.to_json(F.struct(
        F.when(user % 4 != 0, F.col("p_name")).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"),
        F.lit("https://e.example/").alias("url"),
        F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("city"), _pick(user, ["WA", "Washington", "OR"]).alias("region")).alias("venue"),
        F.when(user % 2 == 0, F.array(F.struct(_text("https://o.example/", F.col("event_id")).alias("url")))).alias("offers")))
    rows = pl.parse_payloads(_payloads(spark, d, body, F.col("p_brand").alias("artist")), pl.REGIONAL)
    return pl.map_regional(rows, AS_OF, WEST, ["event_id"]).select(
        "event_id", "title", "artist", "venue", "city", "date", "time", "ticket_url")


# ── feed documents ─────────────────────────────────────────────────────────

def _feed_documents(spark, d, body):
    user = F.col("user_id")
    return shows(spark, d).select(
        "event_id", body.alias("body"), _text("feed", user).alias("source_name"), F.col("n_name").alias("feed_name"),
        F.when(user % 2 == 0, F.col("r_name")).otherwise("").alias("feed_venue"), F.col("r_name").alias("feed_city"),
        F.when(user % 3 == 0, "comedy").alias("feed_category"))


FEED_CATEGORY = "CASE WHEN user_id % 3 = 0 THEN 'comedy' ELSE 'music' END"


@query("read_rss_items", f"""WITH {SHOWS}, items AS (
    SELECT *, 1 AS item, p_name || ' & co - ' || strftime(ts, '%b %-d, %Y') || ' 8:30 PM' AS title, CAST(ts AS DATE) AS date, '20:30' AS time FROM shows
    UNION ALL SELECT *, 2, p_name, CAST({LOCAL} AS DATE), strftime({LOCAL}, '%H:%M') FROM shows)
  SELECT event_id, 'feed' || user_id AS source_name, title, CASE WHEN user_id % 2 = 0 THEN r_name ELSE n_name END AS venue, r_name AS city,
    date, time, {classify_sql("title || CASE WHEN item = 2 AND user_id % 5 = 0 THEN ' Stand-up night' ELSE '' END", FEED_CATEGORY)} AS category,
    CASE WHEN user_id % 3 = 0 THEN 'comedy' ELSE '' END AS genre_tags,
    CASE WHEN item = 1 THEN 'https://f.example/?a=1&b=' || event_id END AS ticket_url,
    CASE WHEN item = 2 THEN 'https://img.example/x.png' END AS image_url FROM items""")
def _(spark, d):
    shown = lambda p: F.date_format("ts", p)
    body = _text(
        '<?xml version="1.0"?><rss><channel><title>Feed</title><item><title>', F.col("p_name"), " &amp; co - ", shown("MMM d, yyyy"),
        " 8:30 PM</title><link>https://f.example/?a=1&amp;b=", F.col("event_id"), "</link></item>\n<item><title> ", F.col("p_name"),
        "\n</title><description>", F.when(F.col("user_id") % 5 == 0, "&lt;p&gt;Stand-up night&lt;/p&gt;").otherwise(""),
        '</description><enclosure url="https://img.example/x.png"/><pubDate>', shown("EEE, dd MMM yyyy HH:mm:ss"),
        " GMT</pubDate></item></channel></rss>")
    items = fd.rss_items(_feed_documents(spark, d, body))
    return fd.map_rss(items, AS_OF, WEST, ["event_id"]).drop("source", "artist", "price_range")


@query("read_ical_events", f"""WITH {SHOWS}, starts AS (SELECT *, CASE user_id % 4 WHEN 0 THEN {LOCAL} WHEN 1 THEN ts
      WHEN 2 THEN date_trunc('day', ts) ELSE ts - INTERVAL 3 HOUR END AS s FROM shows)
  SELECT event_id, p_name || ', live' AS title, CASE WHEN user_id % 2 = 0 THEN r_name ELSE 'Upstairs; ' || n_name END AS venue,
    CAST(s AS DATE) AS date, strftime(s, '%H:%M') AS time,
    {classify_sql("p_name || ', live ' || p_brand", FEED_CATEGORY)} AS category, 'https://c.example/' || event_id AS ticket_url FROM starts""")
def _(spark, d):
    shown = lambda p: F.date_format("ts", p)
    user = F.col("user_id")
    start = (F.when(user % 4 == 0, _text("DTSTART:", shown("yyyyMMdd'T'HHmmss"), "Z"))
             .when(user % 4 == 1, _text("DTSTART:", shown("yyyyMMdd'T'HHmmss")))
             .when(user % 4 == 2, _text("DTSTART;VALUE=DATE:", shown("yyyyMMdd")))
             .otherwise(_text("DTSTART;TZID=America/New_York:", shown("yyyyMMdd'T'HHmmss"))))
    body = _text("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nBEGIN:VEVENT\r\nUID:", F.col("event_id"), "\r\n", start,
                 "\r\nSUMMARY:", F.replace("p_name", F.lit(" "), F.lit("\r\n  ")), "\\, live\r\nLOCATION:Upstairs\\; ", F.col("n_name"),
                 "\r\nDESCRIPTION:", F.col("p_brand"), "\r\nURL:https://c.example/", F.col("event_id"), "\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    events = fd.ical_events(_feed_documents(spark, d, body))
    return fd.map_ical(events, AS_OF, WEST, ["event_id"]).select(
        "event_id", "title", "venue", "date", "time", "category", "ticket_url")



EASTERN = ("BEGIN:VTIMEZONE\r\nTZID:Eastern Standard Time\r\nBEGIN:STANDARD\r\nDTSTART:16011104T020000\r\nRRULE:FREQ=YEARLY;BYDAY=1SU;BYMONTH=11\r\n"
           "TZOFFSETFROM:-0400\r\nTZOFFSETTO:-0500\r\nEND:STANDARD\r\nBEGIN:DAYLIGHT\r\nDTSTART:16010311T020000\r\nRRULE:FREQ=YEARLY;BYDAY=2SU;BYMONTH=3\r\n"
           "TZOFFSETFROM:-0500\r\nTZOFFSETTO:-0400\r\nEND:DAYLIGHT\r\nEND:VTIMEZONE\r\n")
OFFICE = "BEGIN:VTIMEZONE\r\nTZID:Office\r\nBEGIN:STANDARD\r\nDTSTART:19700101T000000\r\nTZOFFSETFROM:+0530\r\nTZOFFSETTO:+0530\r\nEND:STANDARD\r\nEND:VTIMEZONE\r\n"


@query("ical_zones", f"""WITH {SHOWS}, told AS (SELECT event_id, user_id % 3 AS k, ts + to_days(CAST(event_id % 365 AS INTEGER)) AS said FROM shows)
  SELECT event_id, date_trunc('minute', CASE k WHEN 0 THEN timezone('{WEST}', timezone('America/New_York', said))
      WHEN 1 THEN timezone('{WEST}', timezone('UTC', said - INTERVAL 330 MINUTE)) ELSE said END) AS local,
    CASE WHEN k = 2 THEN 'time zone not known: Eastern Standard Time' END AS reason FROM told""")
def _(spark, d):
    """Calendar times in zones that only their document defines, through all seasons, and in one that nothing defines."""
    k = F.col("user_id") % 3
    at = F.date_format(F.col("ts") + F.make_dt_interval((F.col("event_id") % 365).cast("int")), "yyyyMMdd'T'HHmmss")
    body = _text("BEGIN:VCALENDAR\r\n", F.when(k == 0, EASTERN).when(k == 1, OFFICE).otherwise(""), "BEGIN:VEVENT\r\nDTSTART;TZID=",
                 F.when(k == 1, "Office").otherwise("Eastern Standard Time"), ":", at, "\r\nSUMMARY:x\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    events = fd.ical_events(_feed_documents(spark, d, body))
    rows = fd.map_ical(events, AS_OF, WEST, ["event_id"])
    local = F.concat_ws(" ", F.col("date").cast("string"), F.col("time")).cast("timestamp_ntz")
    return rows.select("event_id", local.alias("local")).join(fd.zone_rejects(events, ["event_id"]), "event_id", "left")



# ── feed files larger than a task ──────────────────────────────────────────

FILE_FEED = """concat('Feed ', user_id % 7) AS source_name, CASE WHEN user_id % 7 % 2 = 0 THEN concat('Hall ', user_id % 7) ELSE {other} END AS venue,
    concat('City ', user_id % 7) AS city"""


def _landed_files(spark, d, text, ending):
    """One text a row as files below a folder for each of seven feeds, and the feeds' registry, whose ``feed`` is the folder."""
    path = work_folder(spark, "landed")
    feed = (F.col("user_id") % 7).alias("feed")
    shown = shows(spark, d)
    shown.select(text.alias("value"), feed).write.partitionBy("feed").option("lineSep", ending).text(path)
    k = F.col("feed")
    known = read(spark, d, "events").select(feed).distinct()
    return path, known.select(
        _text("feed=", k).alias("folder"), _text("Feed ", k).alias("source_name"), _text("Feed ", k).alias("feed_name"),
        F.when(k % 2 == 0, _text("Hall ", k)).alias("feed_venue"), _text("City ", k).alias("feed_city"), F.lit(None).cast("string").alias("feed_category"))


def _with_feed(found, known):
    return found.withColumn("folder", F.substring_index("file", "/", 1)).join(known, "folder")


@query("read_rss_files", f"""WITH {SHOWS} SELECT p_name || ' & co' AS title, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time,
    {FILE_FEED.format(other="concat('Feed ', user_id % 7)")}, 'https://f.example/?a=1&b=' || event_id AS ticket_url,
    {classify_sql("p_name || ' & co' || CASE WHEN user_id % 5 = 0 THEN ' Stand-up night' ELSE '' END", "'music'")} AS category FROM shows""")
def _(spark, d):
    """Items in files of a few feeds, each file read in parts; half of them are Atom entries."""
    user, at = F.col("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    about = F.when(user % 5 == 0, "&lt;p&gt;Stand-up night&lt;/p&gt;").otherwise("")
    link = _text("https://f.example/?a=1&amp;b=", F.col("event_id"))
    item = _text("<item>\n<title>", F.col("p_name"), " & co</title><link>", link, "</link><description>", about, "</description><pubDate>", at, "</pubDate></item>")
    entry = _text('<entry><title>', F.col("p_name"), " &amp; co</title><link href='", link, "'/><content>", about, "</content><updated>", at, "</updated></entry>")
    path, known = _landed_files(spark, d, F.when(user % 2 == 0, item).otherwise(entry), "\n<items/></items>\n")
    rows = fd.map_rss(_with_feed(fd.rss_file_items(spark, path), known), AS_OF, "UTC", ["file"])
    return rows.select("title", "date", "time", "source_name", "venue", "city", "ticket_url", "category")


@query("read_ical_files", f"""WITH {SHOWS}, told AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN timezone('UTC', timezone('America/New_York', ts)) ELSE ts END AS s FROM shows)
  SELECT p_name AS title, CAST(s AS DATE) AS date, strftime(s, '%H:%M') AS time, {FILE_FEED.format(other="n_name")},
    'https://c.example/' || event_id AS ticket_url FROM told""")
def _(spark, d):
    """Events in files of a few calendars, each file read in parts; its zones stand at any place of it."""
    at = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    event = _text("BEGIN:VEVENT\r\nDTSTART", F.when(F.col("user_id") % 2 == 0, _text(";TZID=Eastern Standard Time:", at)).otherwise(_text(":", at, "Z")),
                  "\r\nSUMMARY:", F.replace("p_name", F.lit(" "), F.lit("\r\n  ")), "\r\nLOCATION:", F.col("n_name"),
                  "\r\nURL:https://c.example/", F.col("event_id"), "\r\nEND:VEV\r\n ENT\r\n", F.when(F.col("event_id") % 2 == 0, EASTERN).otherwise(""))
    path, known = _landed_files(spark, d, event, EASTERN)
    rows = fd.map_ical(_with_feed(fd.ical_file_events(spark, path), known), AS_OF, "UTC", ["file"])
    return rows.select("title", "date", "time", "source_name", "venue", "city", "ticket_url")



BROKEN = "event_type = 'error'"


@query("isolate_failures", f"""WITH {SHOWS}, kinds AS (SELECT event_id, user_id, event_type, unnest(['rss', 'api', 'page']) AS kind FROM shows)
  SELECT event_id AS run_id, kind || user_id AS source_name, CASE WHEN {BROKEN} THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN {BROKEN} THEN 0 WHEN kind = 'api' THEN 1 ELSE 2 END AS events_found,
    CASE WHEN {BROKEN} OR kind = 'api' THEN 0 ELSE 1 END AS rejected,
    CASE WHEN {BROKEN} THEN CASE kind WHEN 'rss' THEN 'unreadable feed' WHEN 'api' THEN 'unreadable payload'
      ELSE CASE user_id % 2 WHEN 0 THEN 'unreadable page: no page text' ELSE 'unreadable page: selectors.item is not configured' END END END AS error_msg
  FROM kinds""")
def _(spark, d):
    """Three landed documents per show, a feed, a payload and a page; those of error events are broken. What is read out of
    them is stored, since records and rejects are both made of it."""
    broken, user = F.col("event_type") == "error", F.col("user_id")
    landed = stored(shows(spark, d).select(F.col("event_id").alias("run_id"), "event_type", "user_id", "p_name", "n_name"), "landed")

    entry = lambda title, date: _text("<item><title>", title, "</title><pubDate>", date, "</pubDate></item>")
    feed_body = F.when(broken, "<html>gone</html>").otherwise(_text(
        "<rss><channel>", entry("A &nbsp; B & C", "Sat, 06 Jan 2024 20:00:00 GMT"), entry("Plain", "2024-01-07T20:00:00Z"), entry("No day", ""), "</channel></rss>"))
    feed_docs = landed.select(
        "run_id", feed_body.alias("body"), _text("rss", user).alias("source_name"), F.col("n_name").alias("feed_name"),
        *[F.lit("").alias(c) for c in ("feed_venue", "feed_city", "feed_category")])
    items = stored(fd.rss_items(feed_docs), "items")
    rss = stored(fd.map_rss(items, AS_OF, WEST, ["run_id"]).select("run_id"), "rss")

    payload = F.to_json(F.struct(F.struct(F.col("p_name").alias("text")).alias("name"), F.struct(F.lit("2024-01-09T20:00:00").alias("local")).alias("start")))
    api_docs = landed.select(
        "run_id", F.when(broken, F.left(payload, F.length(payload) - 3)).otherwise(payload).alias("body"), _text("api", user).alias("source_name"),
        F.lit("music").alias("category"), F.lit("").alias("default_city"))
    api = stored(pl.map_flat(pl.parse_payloads(api_docs, pl.FLAT), AS_OF, WEST, ["run_id"]).select("run_id"), "api")

    markup = '<ul><li class="e"><p><b>A</b><i>Jan 6, 2024</i><li class="e"><p><b>B</b><i>Jan 7, 2024</i><li class="e"><b>C</b><i>some day</i></ul>'
    selectors = F.struct(
        F.when(~broken | (user % 2 == 0), ".e").alias("item"), F.lit("b").alias("name"), F.lit("i").alias("date"),
        *[F.lit(None).cast("string").alias(c) for c in ("ticketLink", "image", "price")])
    page_docs = landed.select(
        F.col("run_id").alias("page_id"), F.lit("https://x.example/").alias("url"), _text("page", user).alias("source_name"),
        F.when(~broken | (user % 2 == 1), markup).alias("html"), selectors.alias("selectors"))
    raw = stored(ht.html_items(page_docs), "raw")
    no_sites = page_docs.select("source_name", "url", *[F.lit(None).cast("string").alias(c) for c in ("name", "venue", "city", "category")]).where(F.lit(False))
    pages = ht.map_items(raw, no_sites, AS_OF).select(F.col("page_id").alias("run_id"))

    def of(kind, documents, records, rejects):
        return rn.isolate_failures(documents.select("run_id", "source_name"), records, rejects)

    return (of("rss", feed_docs, rss, fd.feed_rejects(feed_docs, items, rss, ["run_id"]))
            .unionByName(of("api", api_docs, api, pl.payload_rejects(api_docs, api, ["run_id"])))
            .unionByName(of("page", page_docs.withColumnRenamed("page_id", "run_id"), pages,
                            ht.rejected_items(raw, AS_OF).select(F.col("page_id").alias("run_id"), "reason"))))


@query("extraction_health", f"""WITH {ITEMS}, pages_of AS (
    SELECT page_id, page_id % 5 AS site, page_id % 7 IN (5, 6) AS broken FROM pages), counted AS (
    SELECT n_nationkey, count(i.pos) FILTER (NOT p.broken) AS matched, count(i.pos) FILTER (NOT p.broken AND p.site <> 3 AND i.pos < 250) AS usable,
      count(i.pos) FILTER (NOT p.broken AND i.pos >= 250) AS cut, count(DISTINCT p.page_id) FILTER (p.broken) AS failed
    FROM nation LEFT JOIN pages_of p ON p.site = n_nationkey LEFT JOIN items i ON i.page_id = p.page_id GROUP BY n_nationkey)
  SELECT 'site' || n_nationkey AS source_name, matched, usable, cut, failed,
    CASE WHEN matched = 0 THEN 'no items matched' WHEN usable = 0 THEN 'matched ' || matched || ' but none usable' ELSE 'ok' END AS verdict,
    CASE WHEN usable > 0 THEN 'ok' ELSE 'error' END AS status FROM counted""")
def _(spark, d):
    """The markup reader's own report, with pages that have no text or no selector among them."""
    n = F.col("page_id")
    pages = _scraped(spark, d).withColumns({"html": F.when(n % 7 != 5, F.col("html")), "selectors": F.when(n % 7 != 6, F.col("selectors"))})
    report = ht.item_report(ht.html_items(pages), AS_OF, max_items=ht.MAX_ITEMS)
    return rn.extraction_health(report, _sites(spark, d))


# ── a whole refresh ────────────────────────────────────────────────────────

KINDS = ["api", "rss", "jsonld", "page"]


def _landed(spark, d, broken=None, only=None):
    """Documents of four kinds, by user: payloads, feeds, pages with JSON-LD, pages to scrape. Some cannot be read: those of
    ``broken`` events. With ``only``, the documents of those events alone."""
    user, number = F.col("user_id"), F.col("event_id")
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    broken = F.col("k") == 7 if broken is None else broken
    docs = stored(shows(spark, d).where(F.lit(True) if only is None else only).select(
        number.alias("doc_id"), _pick(user, KINDS).alias("kind"), user, "p_name", "n_name", "r_name", broken.alias("broken"),
        F.concat(day, F.lit("T"), clock).alias("at")), "landed")
    place = docs.select("user_id", "kind", "n_name", "r_name").distinct()
    name = F.concat("kind", F.col("user_id").cast("string"))
    registry = stored(place.where("kind <> 'api'").select(
        name.alias("id"), F.concat(F.lit("Site "), name).alias("name"), F.when(F.col("kind") == "jsonld", "jsonld").otherwise("rss").alias("type"),
        F.lit("https://site.example/").alias("url"), F.col("n_name").alias("venue"), F.col("r_name").alias("city"),
        F.when(user % 3 == 0, "comedy").alias("category"),
        F.struct(F.lit("li").alias("item"), F.lit("h3").alias("name"), F.lit("time").alias("date"), *[
            F.lit(None).cast("string").alias(c) for c in ("ticketLink", "image", "price")]).alias("selectors")), "registry")
    api = docs.where("kind = 'api'").select("doc_id", F.lit("eventbrite").alias("source_name"), F.to_json(F.struct(
        F.struct(F.col("p_name").alias("text")).alias("name"), F.struct(F.col("at").alias("local")).alias("start"),
        F.struct(F.col("n_name").alias("name")).alias("venue"))).alias("body"), F.lit("music").alias("category"), F.lit("").alias("default_city"))
    item = _text("<rss><item><title>", F.col("p_name"), "</title><pubDate>", F.col("at"), "Z</pubDate><link>https://f.example/", F.col("doc_id"), "</link></item></rss>")
    script = _text('<script type="application/ld+json">{"@type":"Event","name":"', F.col("p_name"), '","startDate":"', F.col("at"), '"}</script>')
    feed = docs.where("kind IN ('rss', 'jsonld')").select("doc_id", name.alias("source_name"), F.when(
        ~F.col("broken"), F.when(F.col("kind") == "rss", item).otherwise(script)).alias("body"))
    pages = docs.where("kind = 'page'").select("doc_id", name.alias("source_name"), F.lit("https://site.example/").alias("url"), F.when(
        ~F.col("broken"), _text("<ul><li><h3>", F.col("p_name"), '</h3><time datetime="', F.col("at"), '"></time></ul>')).alias("html"))
    return {
        "eventbrite": rf.read_api(api, pl.FLAT, pl.map_flat, AS_OF, "UTC"),
        "rss": rf.read_feeds(feed, registry, AS_OF, "UTC"),
        "scraper": rf.read_pages(pages, registry, AS_OF, "UTC"),
    }


def refreshed_sql(lost: str) -> str:
    """``records`` and ``ranked`` of the documents that are not ``lost``; ``failed`` counts the lost ones by source."""
    return SHOWS + f""", landed AS (
  SELECT *, ['api', 'rss', 'jsonld', 'page'][user_id % 4 + 1] AS kind FROM shows), named AS (
  SELECT *, CASE WHEN kind = 'api' THEN 'eventbrite' ELSE kind || user_id END AS source_name,
    CASE kind WHEN 'api' THEN 1 WHEN 'page' THEN 4 ELSE 3 END AS precedence,
    CASE kind WHEN 'api' THEN 'api' WHEN 'page' THEN 'scrape' ELSE 'rss' END AS source FROM landed), failed AS (
  SELECT source_name, source, CASE min(kind) WHEN 'page' THEN 'unreadable page: no page text' ELSE 'unreadable feed' END AS error_msg, count(*) AS failed_docs
  FROM named WHERE {lost} GROUP BY ALL), records AS (
  SELECT *, {norm_sql('p_name')} || '|' || strftime(ts, '%Y-%m-%d') || '|' || {norm_sql('n_name')} AS dedupe_key,
    {classify_sql("CASE WHEN kind = 'api' THEN 'music ' ELSE '' END || p_name", "CASE WHEN kind <> 'api' AND user_id % 3 = 0 THEN 'comedy' ELSE 'music' END")} AS category
  FROM named WHERE NOT ({lost})), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY precedence DESC, event_id DESC) AS newest,
    row_number() OVER (PARTITION BY dedupe_key ORDER BY precedence, event_id) AS oldest,
    ('0x' || substr(md5(first_value(event_id) OVER (PARTITION BY dedupe_key ORDER BY precedence, event_id) || '|0|0'), 1, 15))::BIGINT AS id FROM records)"""


LOST = "kind <> 'api' AND k = 7"
REFRESHED = refreshed_sql(LOST)
TABLE_SQL = """ SELECT dedupe_key, id, source, source_name, p_name AS title, n_name AS venue,
    CASE WHEN kind <> 'api' THEN r_name END AS city, CAST(ts AS DATE) AS event_date, strftime(ts, '%H:%M') AS event_time, category,
    CASE WHEN kind = 'api' THEN 'music' WHEN user_id % 3 = 0 THEN 'comedy' ELSE '' END AS genre_tags,
    CASE WHEN kind = 'rss' THEN 'https://f.example/' || event_id END AS ticket_url FROM ranked WHERE newest = 1"""
TABLE = ["dedupe_key", "id", "source", "source_name", "title", "venue", "city", "event_date", "event_time", "category", "genre_tags", "ticket_url"]
RUN_TIME, NEXT_RUN = "2024-02-01 00:00:00", "2024-02-01 06:00:00"


@query("refresh_all", f"WITH {REFRESHED}{TABLE_SQL}")
def _(spark, d):
    """Landed documents of three adapters to the stored table; an unreadable one costs its own records only."""
    return rf.refresh(None, _landed(spark, d), ntz(RUN_TIME)).select(*TABLE)


@query("refresh_log", f"""WITH {REFRESHED}, good AS (
    SELECT source_name, source, count(*) AS found, count(*) FILTER (oldest = 1) AS added, count(*) FILTER (oldest <> 1) AS updated
    FROM ranked GROUP BY ALL)
  SELECT source_name, source, CASE WHEN found IS NULL THEN 'error' ELSE 'ok' END AS status, coalesce(found, 0) AS found,
    coalesce(added, 0) AS added, coalesce(updated, 0) AS updated, 0 AS invalid, coalesce(failed_docs, 0) AS failed_docs, error_msg
  FROM good FULL JOIN failed USING (source_name, source)""")
def _(spark, d):
    return rf.refresh_log(None, _landed(spark, d), ntz(RUN_TIME)).drop("run_at")


@query("union_sources", f"""WITH {REFRESHED} SELECT event_id AS doc_id, 0 AS block, 0 AS place, precedence, source, source_name, p_name AS title,
    strftime(ts, '%Y-%m-%d') AS date FROM records""")
def _(spark, d):
    """Every record of the refresh, stamped with its adapter's place."""
    return rf.gather(_landed(spark, d)).select(*[F.col("seq").getField(f).alias(f) for f in ("doc_id", "block", "place")], "precedence", "source", "source_name", "title", "date")


@query("dead_letters", f"""WITH {REFRESHED} SELECT CASE kind WHEN 'page' THEN 'scraper' ELSE 'rss' END AS adapter, event_id AS doc_id, source_name,
    CASE kind WHEN 'page' THEN 'unreadable page: no page text' ELSE 'unreadable feed' END AS reason, CAST(2 AS BIGINT) AS attempt,
    TIMESTAMP '{NEXT_RUN}' AS run_at FROM named WHERE {LOST} AND event_id % 3 = 0""")
def _(spark, d):
    """Documents that wait after two runs: both could not read a third of the broken ones, the second read the rest."""
    broken = F.col("k") == 7
    first = _landed(spark, d)
    log = rf.dead_letters(first, None, ntz(RUN_TIME))
    again = _landed(spark, d, broken & (F.col("event_id") % 3 == 0), broken)
    log = log.unionByName(rf.dead_letters(again, log, ntz(NEXT_RUN)))
    read = rf.gather(again).select(F.when(F.col("source") == "scrape", "scraper").otherwise(F.col("source")).alias("adapter"), "seq.doc_id", ntz(NEXT_RUN).alias("run_at"))
    return rf.open_letters(log, read)


@query("refresh_replay", f"WITH {refreshed_sql('kind = $$none$$')}{TABLE_SQL}")
def _(spark, d):
    """The table after the broken documents were repaired and replayed: as if they had been good at once."""
    first = stored(rf.gather(_landed(spark, d)), "records")
    repaired = stored(rf.gather(_landed(spark, d, F.lit(False), (F.col("k") == 7) & (F.col("user_id") % 4 != 0))), "repaired")
    after = upsert(None, normalize(first), ntz(RUN_TIME))
    return rf.replay(None, after, first, repaired, ntz(RUN_TIME)).select(*TABLE)

"""Queries over listings: normalise, merge, filter, sort, page, facets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from playbill.functions import text, urls
from playbill.operators import filters as fl
from playbill.operators import ingest
from playbill.operators.filters import Filters, apply_filters
from playbill.plans.registry import query
from playbill.plans.tables import (
    LISTINGS, NORMAL, RAW, RUN_LOG, STATEFUL, VALID, listings, norm_sql, ntz, raw_listings, read, run_log, shows,
    stateful,
)
from playbill.schema import MUTABLE

FIRST_TIME, NEXT_TIME = "2024-02-01 00:00:00", "2024-02-02 00:00:00"


@query("dedupe_key", f"""SELECT doc_id,
  {norm_sql('text')} || '|2024-01-10|' || {norm_sql('source')} AS dedupe_key FROM documents""")
def _(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", text.dedupe_key("text", F.lit("2024-01-10T20:00"), "source").alias("dedupe_key"))


NORMAL_COLUMNS = "seq, precedence, dedupe_key, " + ", ".join(MUTABLE)


@query("normalize_listing", f"WITH {NORMAL} SELECT {NORMAL_COLUMNS} FROM normal")
def _(spark, d):
    return ingest.normalize(raw_listings(spark, d))


@query("normalize_rejects", f"WITH {RAW} SELECT seq, title, venue, date FROM raw WHERE NOT coalesce({VALID}, false)")
def _(spark, d):
    return ingest.rejects(raw_listings(spark, d)).select("seq", "title", "venue", "date")


@query("category_clamp", f"""WITH {RAW} SELECT seq,
  CASE WHEN lower(category) IN ('music', 'comedy') THEN lower(category) ELSE 'other' END AS category FROM raw""")
def _(spark, d):
    return raw_listings(spark, d).select("seq", text.category_clamp("category").alias("category"))


@query("url_guard", f"""WITH {RAW} SELECT seq, CASE WHEN ticket_url LIKE 'https:%' THEN ticket_url
  WHEN ticket_url LIKE 'HTTP:%' THEN 'http://venue.example/a%20b/' || split_part(ticket_url, '/', 5) END AS url FROM raw""")
def _(spark, d):
    return raw_listings(spark, d).select("seq", urls.url_guard("ticket_url").alias("url"))


def _first_and_next(spark, d):
    """Two refreshes over the raw records: browsing events, then the others."""
    raw = raw_listings(spark, d)
    late = F.col("event_type").isin("purchase", "error")
    stored = ingest.upsert(None, ingest.normalize(raw.where(~late)), ntz(FIRST_TIME))
    return stored, raw.where(late)


LATE = "event_type IN ('purchase', 'error')"
TWO_RUNS = NORMAL + f""", written AS (
  SELECT *, CASE WHEN {LATE} THEN 1 ELSE 0 END AS run FROM normal), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY run DESC, precedence DESC, seq DESC) AS newest,
    first_value(seq) OVER (PARTITION BY dedupe_key ORDER BY run, precedence, seq) AS id,
    min(run) OVER (PARTITION BY dedupe_key) AS first_run, max(run) OVER (PARTITION BY dedupe_key) AS last_run
  FROM written)"""
TWO_RUNS_COLUMNS = f"""dedupe_key, {', '.join(MUTABLE)}, id,
  CASE WHEN first_run = 0 THEN '{FIRST_TIME}' ELSE '{NEXT_TIME}' END AS created_at,
  CASE WHEN last_run = 0 THEN '{FIRST_TIME}' ELSE '{NEXT_TIME}' END AS updated_at, interested, hidden"""


def _readable_times(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")})


@query("upsert_listings", f"""WITH {TWO_RUNS}, rows AS (SELECT *, false AS interested, false AS hidden FROM ranked)
  SELECT {TWO_RUNS_COLUMNS} FROM rows WHERE newest = 1""")
def _(spark, d):
    stored, late = _first_and_next(spark, d)
    return _readable_times(ingest.upsert(stored, ingest.normalize(late), ntz(NEXT_TIME)))


@query("upsert_keeps_flags", f"""WITH {TWO_RUNS}, rows AS (
    SELECT *, first_run = 0 AND id % 3 = 0 AS interested, first_run = 0 AND id % 5 = 0 AS hidden FROM ranked)
  SELECT {TWO_RUNS_COLUMNS} FROM rows WHERE newest = 1""")
def _(spark, d):
    stored, late = _first_and_next(spark, d)
    flagged = stored.withColumns({"interested": F.col("id") % 3 == 0, "hidden": F.col("id") % 5 == 0})
    return _readable_times(ingest.upsert(flagged, ingest.normalize(late), ntz(NEXT_TIME)))


@query("upsert_counts", f"""WITH {NORMAL}, late AS (SELECT * FROM normal WHERE {LATE}),
  totals AS (SELECT (SELECT count(*) FROM raw WHERE {LATE}) AS found, (SELECT count(*) FROM late) AS valid,
    (SELECT count(DISTINCT dedupe_key) FROM late
     WHERE dedupe_key NOT IN (SELECT dedupe_key FROM normal WHERE NOT ({LATE}))) AS added)
  SELECT found, added, valid - added AS updated, found - valid AS invalid FROM totals""")
def _(spark, d):
    stored, late = _first_and_next(spark, d)
    return ingest.upsert_counts(stored, late)


@query("last_write_wins", f"""WITH {NORMAL} SELECT {NORMAL_COLUMNS} FROM normal
  QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY precedence DESC, seq DESC) = 1""")
def _(spark, d):
    return ingest.last_write_wins(ingest.normalize(raw_listings(spark, d)))


@query("ok_runs_only", f"""WITH {RUN_LOG} SELECT l.l_orderkey AS run_id, l.l_linenumber AS line
  FROM lineitem l JOIN run_log r ON r.run_id = l.l_orderkey WHERE r.status = 'ok'""")
def _(spark, d):
    records = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"))
    return ingest.ok_runs_only(records, run_log(spark, d))


@query("run_counts", f"""WITH {RUN_LOG}, found AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT r.run_id, r.source_name, r.status, coalesce(f.n, 0) AS found,
    CASE WHEN r.status = 'ok' THEN coalesce(f.n, 0) ELSE 0 END AS eligible
  FROM run_log r LEFT JOIN found f ON f.l_orderkey = r.run_id""")
def _(spark, d):
    records = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return ingest.run_counts(records, run_log(spark, d))


@query("duplicates_report", f"""WITH {NORMAL}, keys AS (
    SELECT dedupe_key, count(*) AS n_key, count(DISTINCT source_name) AS n_sources FROM normal GROUP BY dedupe_key HAVING count(*) > 1)
  SELECT dedupe_key, source_name, count(*) AS n, n_key, n_sources FROM normal JOIN keys USING (dedupe_key) GROUP BY ALL""")
def _(spark, d):
    return ingest.duplicates_report(ingest.normalize(raw_listings(spark, d)))


@query("line_duplicates", f"""SELECT dedupe_key, count(*) AS n FROM (
  SELECT {norm_sql('p_name')} || '|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || {norm_sql('s_name')} AS dedupe_key
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
  GROUP BY dedupe_key HAVING count(*) > 1""")
def _(spark, d):
    """Key collisions over the largest table.

    Names are normalised in their own tables, once each, not once per line.
    """
    parts = read(spark, d, "part").select("p_partkey", text.norm("p_name").alias("name"))
    suppliers = read(spark, d, "supplier").select("s_suppkey", text.norm("s_name").alias("place"))
    rows = (read(spark, d, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
            .join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    keyed = rows.groupBy("name", day.alias("day"), "place").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.select(F.concat_ws("|", "name", "day", "place").alias("dedupe_key"), "n")


def _form(spark, d):
    """Form posts built from shows; both names of the tags and link fields occur."""
    user = F.col("user_id")
    return shows(spark, d).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("p_name")).alias("title"),
        F.col("p_brand").alias("artist"), F.col("n_name").alias("venue"), F.lit("").alias("city"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("doors_time"),
        F.lit("").alias("category"), F.when(user % 2 == 0, F.lower("p_type")).alias("tags"),
        F.col("p_name").alias("genre_tags"),
        F.when(user % 3 == 0, F.concat(F.lit("https://own.example/"), F.col("k").cast("string"))).alias("url"),
        F.lit("https://alt.example/").alias("ticket_url"), F.lit(None).cast("string").alias("image_url"),
        F.lit("").alias("price_range"))


MANUAL = f"""WITH {NORMAL}, form AS (
    SELECT event_id AS seq, 5 AS precedence, 1 AS run, {norm_sql('p_name')} || '|' || strftime(ts, '%Y-%m-%d') || '|' || {norm_sql('n_name')} AS dedupe_key,
      'manual' AS source, 'manual' AS source_name, p_name AS title, p_brand AS artist, n_name AS venue,
      CAST(ts AS DATE) AS event_date, 'other' AS category,
      CASE WHEN user_id % 2 = 0 THEN lower(p_type) ELSE p_name END AS genre_tags,
      CASE WHEN user_id % 3 = 0 THEN 'https://own.example/' || k ELSE 'https://alt.example/' END AS ticket_url
    FROM shows WHERE event_type NOT IN ('error', 'signup')), written AS (
    SELECT * FROM form UNION ALL SELECT seq, precedence, 0, dedupe_key, source, source_name, title, artist, venue, event_date, category, genre_tags, ticket_url
    FROM normal WHERE NOT ({LATE})), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY run DESC, precedence DESC, seq DESC) AS newest,
      first_value(seq) OVER (PARTITION BY dedupe_key ORDER BY run, precedence, seq) AS id FROM written)"""


@query("manual_append", f"""{MANUAL} SELECT dedupe_key, id, source, source_name, title, artist, venue, event_date, category,
    genre_tags, ticket_url FROM ranked WHERE newest = 1""")
def _(spark, d):
    """Form posts merged into the stored table."""
    stored, _ = _first_and_next(spark, d)
    merged = ingest.upsert(stored, ingest.normalize(ingest.manual_records(_form(spark, d))), ntz(NEXT_TIME))
    return merged.select("dedupe_key", "id", "source", "source_name", "title", "artist", "venue", "event_date", "category",
                         "genre_tags", "ticket_url")


@query("refresh_one_source", f"""WITH {NORMAL}, written AS (
    SELECT *, CASE WHEN {LATE} THEN 1 ELSE 0 END AS run FROM normal WHERE NOT ({LATE}) OR source_name = 'src3'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY run DESC, precedence DESC, seq DESC) AS newest
    FROM written)
  SELECT dedupe_key, {', '.join(MUTABLE)} FROM ranked WHERE newest = 1""")
def _(spark, d):
    stored, late = _first_and_next(spark, d)
    known = raw_listings(spark, d).select("source_name").distinct()
    merged = ingest.refresh_one_source(stored, ingest.normalize(late), "src3", known, ntz(NEXT_TIME))
    return merged.select("dedupe_key", *MUTABLE)


@query("artists_of_interest", f"WITH {LISTINGS} SELECT DISTINCT artist FROM listings WHERE interested AND artist <> ''")
def _(spark, d):
    return ingest.artists_of_interest(listings(spark, d))


# ── filters ────────────────────────────────────────────────────────────────

def _filter_query(name, f, where):
    @query(name, f"WITH {LISTINGS} SELECT id, title, event_date FROM listings WHERE {where}")
    def _(spark, d):
        return apply_filters(listings(spark, d), f).select("id", "title", "event_date")


DAY = dt.date
_filter_query("f_category", Filters(category="music"), "category = 'music' AND NOT hidden")
_filter_query("f_category_all", Filters(category="all"), "NOT hidden")
_filter_query("f_city", Filters(city="ASIA"), "city = 'ASIA' AND NOT hidden")
_filter_query("f_sources", Filters(sources=["src1", "src5"]), "source_name IN ('src1', 'src5') AND NOT hidden")
_filter_query("f_date_range", Filters(date_from=DAY(2024, 1, 8), date_to=DAY(2024, 1, 14)),
              "event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND NOT hidden")


def _state_query(name, f, where):
    """Filters over the flags of the action log."""
    @query(name, f"WITH {STATEFUL} SELECT id, title, event_date, interested, hidden FROM stateful WHERE {where}")
    def _(spark, d):
        return apply_filters(stateful(spark, d), f).select("id", "title", "event_date", "interested", "hidden")


_state_query("f_hidden", Filters(show_hidden=True), "true")
_state_query("f_visible", Filters(), "NOT hidden")
_state_query("f_interested", Filters(only_interested=True), "interested AND NOT hidden")
_filter_query("f_search", Filters(search="ReD%g"),
              "(title ILIKE '%red%g%' OR artist ILIKE '%red%g%' OR venue ILIKE '%red%g%') AND NOT hidden")
_filter_query("f_search_artist", Filters(search="brand#1_"),
              "(title ILIKE '%brand#1_%' OR artist ILIKE '%brand#1_%' OR venue ILIKE '%brand#1_%') AND NOT hidden")
_filter_query("f_genres", Filters(genres=["romo", "Widget"]),
              "(genre_tags ILIKE '%romo%' OR genre_tags ILIKE '%widget%') AND NOT hidden")
_filter_query("f_combined", Filters(
    category="music", city="EUROPE", sources=["src0", "src2", "src4", "src6"], genres=["ring", "bolt"],
    date_from=DAY(2024, 1, 5), date_to=DAY(2024, 1, 25), search="r", show_hidden=True),
    """category = 'music' AND city = 'EUROPE' AND source_name IN ('src0', 'src2', 'src4', 'src6')
       AND (genre_tags ILIKE '%ring%' OR genre_tags ILIKE '%bolt%')
       AND event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
       AND (title ILIKE '%r%' OR artist ILIKE '%r%' OR venue ILIKE '%r%')""")


@query("get_by_id", f"WITH {LISTINGS} SELECT id, title, venue FROM listings WHERE id = 417")
def _(spark, d):
    return fl.get_by_id(listings(spark, d), 417).select("id", "title", "venue")


# ── sorts, pages, counts ───────────────────────────────────────────────────

ROW = ["id", "title", "venue", "event_date", "event_time"]
ROW_SQL = ", ".join(ROW)
DATE_SQL = "event_date NULLS FIRST, event_time NULLS FIRST, id"


@query("sort_date", f"WITH {LISTINGS} SELECT {ROW_SQL} FROM listings WHERE NOT hidden ORDER BY {DATE_SQL}")
def _(spark, d):
    return apply_filters(listings(spark, d), Filters()).orderBy(*fl.date_order()).select(ROW)


@query("sort_venue", f"WITH {LISTINGS} SELECT {ROW_SQL} FROM listings WHERE NOT hidden ORDER BY lower(venue), event_date, id LIMIT 200 OFFSET 600")
def _(spark, d):
    return fl.page(apply_filters(listings(spark, d), Filters()), "venue", 4, 999).select(ROW)


@query("page_after", f"""WITH {LISTINGS} SELECT {ROW_SQL} FROM listings WHERE NOT hidden
  AND (event_date, coalesce(event_time, ''), id) > (DATE '2024-01-12', '08:00', 0) ORDER BY {DATE_SQL} LIMIT 50""")
def _(spark, d):
    return fl.page_after(apply_filters(listings(spark, d), Filters()), (DAY(2024, 1, 12), "08:00", 0)).select(ROW)


@query("count_listings", f"WITH {LISTINGS} SELECT count(*) AS n FROM listings WHERE category = 'music' AND NOT hidden")
def _(spark, d):
    return fl.count_listings(apply_filters(listings(spark, d), Filters(category="music")))


@query("page_meta", f"""WITH {LISTINGS} SELECT count(*) AS total, 2 AS page, 200 AS page_size,
  CAST(ceil(count(*) / 200.0) AS BIGINT) AS pages FROM listings WHERE NOT hidden""")
def _(spark, d):
    return fl.page_meta(apply_filters(listings(spark, d), Filters()), 2, 500)


# ── facets ─────────────────────────────────────────────────────────────────

@query("facet_cities", f"WITH {LISTINGS} SELECT DISTINCT city FROM listings WHERE city <> '' ORDER BY city")
def _(spark, d):
    return fl.facet_cities(listings(spark, d))


@query("facet_sources", f"WITH {LISTINGS} SELECT DISTINCT source_name FROM listings ORDER BY 1")
def _(spark, d):
    return fl.facet_sources(listings(spark, d))


@query("facet_tags", f"WITH {LISTINGS} SELECT DISTINCT unnest(string_split(genre_tags, ', ')) AS tag FROM listings ORDER BY 1")
def _(spark, d):
    return fl.facet_tags(listings(spark, d))


@query("facets_all", f"""WITH {LISTINGS} SELECT DISTINCT 'city' AS facet, city AS value FROM listings WHERE city <> ''
  UNION ALL SELECT DISTINCT 'source', source_name FROM listings
  UNION ALL SELECT DISTINCT 'tag', unnest(string_split(genre_tags, ', ')) FROM listings ORDER BY 1, 2""")
def _(spark, d):
    return fl.facets_all(listings(spark, d))


@query("facets_kept", f"""WITH {TWO_RUNS}, stored AS (SELECT * FROM ranked WHERE newest = 1)
  SELECT 'city' AS facet, city AS value, count(*) AS n FROM stored WHERE city <> '' GROUP BY city
  UNION ALL SELECT 'source', source_name, count(*) FROM stored GROUP BY source_name
  UNION ALL SELECT 'tag', tag, count(DISTINCT dedupe_key) FROM (
    SELECT dedupe_key, unnest(string_split(genre_tags, ', ')) AS tag FROM stored) GROUP BY tag""")
def _(spark, d):
    """Counted once for the stored table, then changed by a batch from the rows it touches alone."""
    stored, late = _first_and_next(spark, d)
    batch = ingest.normalize(late)
    before = stored.join(batch.select("dedupe_key").distinct(), "dedupe_key", "left_semi")
    after = ingest.upsert(before, batch, ntz(NEXT_TIME))
    return fl.change_facets(fl.facet_counts(stored), fl.facet_changes(before, after))


@query("parse_tags", f"""WITH {RAW} SELECT seq, unnest(list_transform(string_split(genre_tags, ','), lambda x: lower(trim(x)))) AS tag FROM raw""")
def _(spark, d):
    return raw_listings(spark, d).select("seq", F.explode(text.parse_tags("genre_tags")).alias("tag"))

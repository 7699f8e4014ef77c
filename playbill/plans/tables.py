"""Listing-shaped tables over the given Parquet files, in Spark and in SQL.

Every builder is a narrow projection of scans plus equi-joins without hints, so
small dimensions are broadcast by their measured size and large ones shuffled.
The SQL constants define the same tables for the comparison engine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2024, 1, 10)
NOW = dt.datetime(2024, 2, 20, 12, 0)


# Schemas of the given tables: naming them spares a schema-inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """events as a stream of files; pass it to the builders below as ``events``."""
    # A file stream wants a pattern or a folder, also for a single file.
    return spark.readStream.schema(SCHEMAS["events"]).parquet(f"{folder}/events*.parquet")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _pick(number: Column, values: list[str]) -> Column:
    """The value at ``number`` modulo the list's length."""
    out = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        out = F.when(number % len(values) == i, values[i]).otherwise(out)
    return out


def shows(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """events joined with the part, nation and region each one points to."""
    found = (read(spark, folder, "events") if events is None else events).withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))
    part = read(spark, folder, "part")
    nation = read(spark, folder, "nation")
    region = read(spark, folder, "region")
    return (found.join(part, F.col("k") == F.col("p_partkey"))
            .join(nation, (F.col("user_id") % 25) == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))


SHOWS = """shows AS (
  SELECT e.*, CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT) AS k, p.*, n.*, r.*
  FROM events e
  JOIN part p ON p.p_partkey = CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT)
  JOIN nation n ON n.n_nationkey = e.user_id % 25
  JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def genre_tags() -> Column:
    return F.concat(F.lower("p_type"), F.lit(", "), F.replace("p_name", F.lit(" "), F.lit(", ")))


def category() -> Column:
    return (F.when(F.col("p_type").isin("STANDARD", "PROMO", "ECONOMY"), "music")
            .when(F.col("p_type") == "SMALL", "comedy").otherwise("other"))


def listings(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """The stored listings table: one row per event, id = event_id."""
    user = F.col("user_id")
    return shows(spark, folder, events).select(
        F.col("event_id").alias("id"),
        _pick(user, ["api", "rss", "scrape", "manual"]).alias("source"),
        F.concat(F.lit("src"), (user % 8).cast("string")).alias("source_name"),
        F.col("p_name").alias("title"),
        F.when(user % 17 == 0, "").when(user % 13 != 0, F.col("p_brand")).alias("artist"),
        F.col("n_name").alias("venue"),
        F.when(user % 11 == 0, "").otherwise(F.col("r_name")).alias("city"),
        F.col("ts").cast("date").alias("event_date"),
        F.when(F.col("event_type") != "view", F.date_format("ts", "HH:mm")).alias("event_time"),
        category().alias("category"),
        genre_tags().alias("genre_tags"),
        F.when(user % 4 == 0, F.concat(F.lit("https://tix.example/e/"), F.col("event_id").cast("string"))).alias("ticket_url"),
        F.when(user % 5 != 0, F.concat(F.lit("$"), F.col("p_size").cast("string"))).alias("price_range"),
        (F.col("event_type") == "purchase").alias("interested"),
        (F.col("event_type") == "error").alias("hidden"),
        F.col("ts"),
    )


LISTINGS = SHOWS + """, listings AS (
  SELECT event_id AS id,
    CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'rss' WHEN 2 THEN 'scrape' ELSE 'manual' END AS source,
    'src' || (user_id % 8) AS source_name, p_name AS title,
    CASE WHEN user_id % 17 = 0 THEN '' WHEN user_id % 13 <> 0 THEN p_brand END AS artist,
    n_name AS venue, CASE WHEN user_id % 11 = 0 THEN '' ELSE r_name END AS city,
    CAST(ts AS DATE) AS event_date,
    CASE WHEN event_type <> 'view' THEN strftime(ts, '%H:%M') END AS event_time,
    CASE WHEN p_type IN ('STANDARD', 'PROMO', 'ECONOMY') THEN 'music'
         WHEN p_type = 'SMALL' THEN 'comedy' ELSE 'other' END AS category,
    lower(p_type) || ', ' || replace(p_name, ' ', ', ') AS genre_tags,
    CASE WHEN user_id % 4 = 0 THEN 'https://tix.example/e/' || event_id END AS ticket_url,
    CASE WHEN user_id % 5 <> 0 THEN '$' || p_size END AS price_range,
    event_type = 'purchase' AS interested, event_type = 'error' AS hidden, ts
  FROM shows)"""


def stateful(spark: SparkSession, folder: str) -> DataFrame:
    """The stored listings with the flags that the action log gives their keys."""
    from playbill.functions.text import dedupe_key
    from playbill.operators.feedback import current_state, with_state

    keyed = listings(spark, folder).withColumn("dedupe_key", dedupe_key("title", F.date_format("event_date", "yyyy-MM-dd"), "venue"))
    return with_state(keyed, current_state(actions(spark, folder)))


def raw_listings(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Unvalidated adapter records: blanks, odd dates, unsafe links, mixed case."""
    user, event = F.col("user_id"), F.col("event_id")
    number = event.cast("string")
    return shows(spark, folder, events).select(
        event.alias("seq"),
        F.when(user % 10 == 3, "").otherwise(_pick(user, ["api", "rss", "scrape", "manual"])).alias("source"),
        F.when(user % 10 == 4, "").otherwise(F.concat(F.lit("src"), (user % 8).cast("string"))).alias("source_name"),
        (user % 4).cast("int").alias("precedence"),
        F.when(event % 53 == 0, "").when(event % 59 == 0, "   ")
        .when(user % 3 == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit("! ")))
        .when(user % 3 == 2, F.concat(F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("title"),
        F.when(user % 17 == 0, "").otherwise(F.col("p_brand")).alias("artist"),
        F.when(event % 61 != 0, F.when(user % 25 == 7, F.concat(F.lit("Café "), F.col("n_name")))
               .otherwise(F.col("n_name"))).alias("venue"),
        F.when(user % 11 == 0, "").otherwise(F.col("r_name")).alias("city"),
        F.when(event % 47 == 0, F.date_format("ts", "yyyy/MM/dd")).when(event % 43 == 0, "TBA")
        .when(event % 41 == 0, "2024-99-99")
        .when(user % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("event_type") == "view", "").otherwise(F.date_format("ts", "HH:mm")).alias("time"),
        F.lit(None).cast("string").alias("doors_time"),
        F.when(F.col("p_type") == "STANDARD", "Music").when(F.col("p_type") == "SMALL", "COMEDY")
        .when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("category"),
        genre_tags().alias("genre_tags"),
        F.when(user % 4 == 0, F.concat(F.lit("https://tix.example/e/"), number))
        .when(user % 4 == 1, F.concat(F.lit("javascript:open("), number, F.lit(")")))
        .when(user % 4 == 2, F.concat(F.lit("/relative/"), number))
        .otherwise(F.concat(F.lit("HTTP://Venue.Example/a b/"), number)).alias("ticket_url"),
        F.when(user % 5 != 0, F.concat(F.lit("https://img.example/"), F.col("k").cast("string"), F.lit(".png"))).alias("image_url"),
        F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("$"), F.col("p_size").cast("string"))).alias("price_range"),
        "event_type",
    )


RAW = SHOWS + """, raw AS (
  SELECT event_id AS seq,
    CASE WHEN user_id % 10 = 3 THEN '' ELSE CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'rss' WHEN 2 THEN 'scrape' ELSE 'manual' END END AS source,
    CASE WHEN user_id % 10 = 4 THEN '' ELSE 'src' || (user_id % 8) END AS source_name,
    CAST(user_id % 4 AS INTEGER) AS precedence,
    CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN '   '
         WHEN user_id % 3 = 1 THEN '  ' || p_name || '! ' WHEN user_id % 3 = 2 THEN upper(p_name) || ' ' ELSE p_name END AS title,
    CASE WHEN user_id % 17 = 0 THEN '' ELSE p_brand END AS artist,
    CASE WHEN event_id % 61 <> 0 THEN CASE WHEN user_id % 25 = 7 THEN 'Café ' || n_name ELSE n_name END END AS venue,
    CASE WHEN user_id % 11 = 0 THEN '' ELSE r_name END AS city,
    CASE WHEN event_id % 47 = 0 THEN strftime(ts, '%Y/%m/%d') WHEN event_id % 43 = 0 THEN 'TBA'
         WHEN event_id % 41 = 0 THEN '2024-99-99' WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
         ELSE strftime(ts, '%Y-%m-%d') END AS date,
    CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%H:%M') END AS time,
    CAST(NULL AS VARCHAR) AS doors_time,
    CASE WHEN p_type = 'STANDARD' THEN 'Music' WHEN p_type = 'SMALL' THEN 'COMEDY' WHEN p_type <> 'ECONOMY' THEN p_type END AS category,
    lower(p_type) || ', ' || replace(p_name, ' ', ', ') AS genre_tags,
    CASE user_id % 4 WHEN 0 THEN 'https://tix.example/e/' || event_id WHEN 1 THEN 'javascript:open(' || event_id || ')'
         WHEN 2 THEN '/relative/' || event_id ELSE 'HTTP://Venue.Example/a b/' || event_id END AS ticket_url,
    CASE WHEN user_id % 5 <> 0 THEN 'https://img.example/' || k || '.png' END AS image_url,
    CASE WHEN event_type = 'view' THEN '' ELSE '$' || p_size END AS price_range, event_type, ts
  FROM shows)"""


def norm_sql(text: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({text}, ''))), "
            f"'[^0-9A-Za-z_\\s]', '', 'g'), '\\s+', ' ', 'g'))")


VALID = """trim(title) <> '' AND trim(coalesce(venue, '')) <> ''
    AND regexp_matches(left(date, 10), '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(left(date, 10) AS DATE) IS NOT NULL"""

NORMAL = RAW + f""", normal AS (
  SELECT seq, precedence,
    {norm_sql('title')} || '|' || left(date, 10) || '|' || {norm_sql('venue')} AS dedupe_key,
    CASE WHEN source = '' THEN 'api' ELSE source END AS source,
    CASE WHEN source_name <> '' THEN source_name WHEN source <> '' THEN source ELSE 'unknown' END AS source_name,
    trim(title) AS title, nullif(artist, '') AS artist, trim(venue) AS venue, nullif(city, '') AS city,
    CAST(left(date, 10) AS DATE) AS event_date, nullif(time, '') AS event_time, doors_time,
    CASE WHEN lower(category) IN ('music', 'comedy') THEN lower(category) ELSE 'other' END AS category,
    genre_tags,
    CASE WHEN ticket_url LIKE 'https:%' THEN ticket_url
         WHEN ticket_url LIKE 'HTTP:%' THEN 'http://venue.example/a%20b/' || split_part(ticket_url, '/', 5) END AS ticket_url,
    image_url, nullif(price_range, '') AS price_range, event_type, ts
  FROM raw WHERE {VALID})"""


def actions(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Action log: purchase marks, click unmarks, error hides, signup unhides."""
    from playbill.functions.text import dedupe_key

    kind = F.col("event_type")
    return shows(spark, folder, events).where(kind != "view").select(
        F.col("event_id").alias("seq"), "ts",
        dedupe_key("p_name", F.date_format("ts", "yyyy-MM-dd"), "n_name").alias("dedupe_key"),
        F.when(kind.isin("purchase", "click"), "interested").otherwise("hidden").alias("attr"),
        F.when(kind.isin("purchase", "error"), 1).otherwise(0).alias("val"))


ACTIONS = SHOWS + f""", actions AS (
  SELECT event_id AS seq, ts,
    {norm_sql('p_name')} || '|' || strftime(ts, '%Y-%m-%d') || '|' || {norm_sql('n_name')} AS dedupe_key,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'interested' ELSE 'hidden' END AS attr,
    CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS val
  FROM shows WHERE event_type <> 'view'), state AS (
  SELECT dedupe_key,
    coalesce(max_by(val, seq) FILTER (attr = 'interested') = 1, false) AS interested,
    coalesce(max_by(val, seq) FILTER (attr = 'hidden') = 1, false) AS hidden
  FROM actions GROUP BY dedupe_key)"""


STATEFUL = ACTIONS + LISTINGS.removeprefix(SHOWS) + f""", stateful AS (
  SELECT l.* REPLACE (coalesce(s.interested, false) AS interested, coalesce(s.hidden, false) AS hidden)
  FROM listings l LEFT JOIN state s
    ON s.dedupe_key = {norm_sql('l.title')} || '|' || strftime(l.event_date, '%Y-%m-%d') || '|' || {norm_sql('l.venue')})"""


def marks(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Interest marks with the tags and artist of the marked listing."""
    return listings(spark, folder, events).where("interested").select("genre_tags", "artist", "ts")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    from playbill.operators.feedback import record_signals, signal_rows

    return record_signals(signal_rows(marks(spark, folder)))


SIGNALS = LISTINGS + """, signals AS (
  SELECT tag, CAST(count(*) AS DOUBLE) AS signal_count, max(ts) AS last_signal FROM (
    SELECT unnest(string_split(genre_tags, ', ')) AS tag, ts FROM listings WHERE interested
    UNION ALL SELECT lower(artist), ts FROM listings WHERE interested AND artist <> '')
  GROUP BY tag)"""


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """Genre weights from the parts table: one per distinct word of a part name."""
    words = read(spark, folder, "part").select(
        F.explode(F.split("p_name", " ")).alias("genre"), "p_size")
    return words.groupBy("genre").agg((F.max("p_size") % 5 + 1).alias("weight")).where(F.col("genre") != "small")


WEIGHTS = """weights AS (
  SELECT genre, CAST(max(p_size) % 5 + 1 AS INTEGER) AS weight
  FROM (SELECT unnest(string_split(p_name, ' ')) AS genre, p_size FROM part)
  GROUP BY genre HAVING genre <> 'small')"""


def run_log(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    source = read(spark, folder, "events") if events is None else events
    return source.select(
        F.col("event_id").alias("run_id"), _pick(user, ["api", "rss", "scrape", "manual"]).alias("source"),
        F.concat(F.lit("src"), (user % 40).cast("string")).alias("source_name"),
        F.when(kind == "error", "error").when(kind == "signup", "skipped").otherwise("ok").alias("status"),
        F.get_json_object("props", "$.k").cast("long").alias("events_found"),
        F.floor("value").alias("events_added"),
        F.when(kind == "error", F.concat(F.lit("HTTP 500 for "), F.col("event_id").cast("string"))).alias("error_msg"),
        F.col("ts").alias("run_at"))


RUN_LOG = """run_log AS (
  SELECT event_id AS run_id,
    CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'rss' WHEN 2 THEN 'scrape' ELSE 'manual' END AS source,
    'src' || (user_id % 40) AS source_name,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS events_found, CAST(floor(value) AS BIGINT) AS events_added,
    CASE WHEN event_type = 'error' THEN 'HTTP 500 for ' || event_id END AS error_msg, ts AS run_at
  FROM events)"""

"""Raw records from three JSON APIs, read from landed payload text.

Each ``map_*`` takes rows with a parsed ``e`` struct; the schema to parse with
stands beside it. Records without a date are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf, parse_date, parse_time
from playbill.functions.text import classify, project_where, truthy

UNKNOWN_VENUE = "Unknown Venue"
# Regions whose artist dates are kept.
LOCAL_REGIONS = ["WA", "Washington"]

NESTED = """
  name string, url string,
  dates struct<start: struct<localDate: string, localTime: string>>,
  images array<struct<url: string, width: int>>,
  priceRanges array<struct<min: string, max: string>>,
  classifications array<struct<segment: struct<name: string>, genre: struct<name: string>, subGenre: struct<name: string>>>,
  _embedded struct<venues: array<struct<name: string, city: struct<name: string>>>, attractions: array<struct<name: string>>>
"""
FLAT = """
  name struct<text: string>, url string, is_free boolean, logo struct<url: string>,
  start struct<local: string, utc: string>,
  venue struct<name: string, address: struct<city: string>>
"""
REGIONAL = """
  title string, datetime string, url string, artist struct<image_url: string>,
  venue struct<name: string, city: string, region: string>, offers array<struct<url: string>>
"""


def _none() -> Column:
    return F.lit(None).cast("string")


def _amount(c: Column) -> Column:
    """A JSON number as plain text: 25.0 is 25, 59.50 is 59.5."""
    short = F.regexp_replace(c, r"^(-?\d+(?:\.\d*[1-9])?)\.?0*$", "$1")
    return F.coalesce(F.when(c.contains("."), short).otherwise(c), F.lit("undefined"))


def _record(rows: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    return project_where(rows, keep, fields, lambda r: r["date"].isNotNull())


def map_nested(rows: DataFrame, as_of: AsOf, zone: str, keep: list[str]) -> DataFrame:
    """Ticketing API: first venue, classification and price range; widest image.

    Needs (e, default_city).
    """
    e = F.col("e")
    kind = F.get(e["classifications"], F.lit(0))
    venue = F.get(e["_embedded"]["venues"], F.lit(0))
    genres = F.transform(
        F.filter(F.array(kind["genre"]["name"], kind["subGenre"]["name"]),
                 lambda g: (F.coalesce(g, F.lit("")) != "") & (g != "Undefined")), F.lower)
    with_url = F.filter(e["images"], lambda i: F.coalesce(i["url"], F.lit("")) != "")
    # Equal widths keep the listed order, so the earliest of the widest wins.
    widest = F.reduce(with_url, F.lit(None).cast("struct<url:string,width:int>"), lambda best, i: F.when(
        best.isNull() | (F.coalesce(i["width"], F.lit(0)) > F.coalesce(best["width"], F.lit(0))), i).otherwise(best))
    price = F.get(e["priceRanges"], F.lit(0))
    return _record(
        rows, keep, source=F.lit("api"), source_name=F.lit("ticketmaster"), title=e["name"],
        artist=F.get(e["_embedded"]["attractions"], F.lit(0))["name"],
        venue=F.coalesce(truthy(venue["name"]), F.lit(UNKNOWN_VENUE)),
        city=F.coalesce(truthy(venue["city"]["name"]), F.col("default_city")),
        date=parse_date(e["dates"]["start"]["localDate"], as_of, zone),
        time=parse_time(e["dates"]["start"]["localTime"], zone), doors_time=_none(),
        category=classify(F.concat_ws(" ", F.coalesce(kind["segment"]["name"], F.lit("")), F.array_join(genres, " ")), "music"),
        genre_tags=F.array_join(genres, ", "), ticket_url=truthy(e["url"]), image_url=widest["url"],
        price_range=F.when(price.isNotNull(), F.concat(
            F.lit("$"), _amount(price["min"]), F.lit("–$"), _amount(price["max"]))))


def map_flat(rows: DataFrame, as_of: AsOf, zone: str, keep: list[str]) -> DataFrame:
    """Second ticketing API: local start else UTC; free events say so.

    Needs (e, category, default_city), the latter two from the request.
    """
    e = F.col("e")
    start = F.coalesce(truthy(e["start"]["local"]), truthy(e["start"]["utc"]))
    title = truthy(e["name"]["text"])
    return _record(
        rows, keep, source=F.lit("api"), source_name=F.lit("eventbrite"),
        title=F.coalesce(title, F.lit("Untitled")), artist=_none(),
        venue=F.coalesce(truthy(e["venue"]["name"]), F.lit(UNKNOWN_VENUE)),
        city=F.coalesce(truthy(e["venue"]["address"]["city"]), F.col("default_city")),
        date=parse_date(start, as_of, zone), time=parse_time(start, zone), doors_time=_none(),
        category=classify(F.concat_ws(" ", F.col("category"), F.coalesce(title, F.lit(""))), F.col("category")),
        genre_tags=F.col("category"), ticket_url=truthy(e["url"]), image_url=truthy(e["logo"]["url"]),
        price_range=F.when(e["is_free"], "Free"))


def map_regional(rows: DataFrame, as_of: AsOf, zone: str, keep: list[str]) -> DataFrame:
    """Artist API: dates in the local region only. Needs (e, artist)."""
    e = F.col("e")
    local = rows.where(e["venue"]["region"].isin(LOCAL_REGIONS))
    return _record(
        local, keep, source=F.lit("api"), source_name=F.lit("bandsintown"),
        title=F.coalesce(truthy(e["title"]), F.col("artist")), artist=F.col("artist"),
        venue=F.coalesce(truthy(e["venue"]["name"]), F.lit(UNKNOWN_VENUE)), city=truthy(e["venue"]["city"]),
        date=parse_date(e["datetime"], as_of, zone), time=parse_time(e["datetime"], zone), doors_time=_none(),
        category=F.lit("music"), genre_tags=F.lit("music"),
        ticket_url=F.coalesce(truthy(F.get(e["offers"], F.lit(0))["url"]), truthy(e["url"])),
        image_url=truthy(e["artist"]["image_url"]), price_range=_none())


def payload_rejects(payloads: DataFrame, records: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, reason) of payloads without a record: unreadable ones, and readable ones that hold no date or are not wanted."""
    unread = F.try_parse_json(F.col(body)).isNull()
    rest = payloads.join(records.select(*keys).distinct(), keys, "left_anti")
    return rest.select(*keys, F.when(unread, "unreadable payload").otherwise("payload without a record").alias("reason"))


def parse_payloads(payloads: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Payload text to the ``e`` struct; unreadable payloads give a null struct.

    Parsed inside a generator, so later filters cannot repeat the parsing.
    """
    return payloads.select(*[c for c in payloads.columns if c != body],
                           F.explode(F.array(F.from_json(body, schema))).alias("e"))

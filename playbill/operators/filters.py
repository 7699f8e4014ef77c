"""The shared filter set, sorts, paging, counts and facets."""

from __future__ import annotations

import datetime as dt
import string
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from playbill.functions.text import col, parse_tags

DEFAULT_PAGE, MAX_PAGE = 50, 200
ID_RANGES = 4096


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def matches(c: Column | str, needle: str) -> Column:
    """Substring LIKE, ASCII case-insensitive; ``%`` and ``_`` stay wildcards."""
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in needle)
    return ascii_lower(c).like("%" + lowered.replace("\\", "\\\\") + "%")


def any_of(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts)


@dataclass(frozen=True)
class Filters:
    """All optional, combined with AND. Hidden listings are left out by default."""

    category: str | None = None
    city: str | None = None
    sources: list[str] = field(default_factory=list)
    genres: list[str] = field(default_factory=list)
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    show_hidden: bool = False
    only_interested: bool = False
    search: str | None = None


def apply_filters(listings: DataFrame, f: Filters) -> DataFrame:
    """Predicates stay on plain typed columns so they reach the scan."""
    keep: list[Column] = []
    if f.category and f.category != "all":
        keep.append(F.col("category") == f.category)
    if f.city and f.city != "all":
        keep.append(F.col("city") == f.city)
    if f.sources:
        keep.append(F.col("source_name").isin(f.sources))
    if f.date_from:
        keep.append(F.col("event_date") >= F.lit(f.date_from))
    if f.date_to:
        keep.append(F.col("event_date") <= F.lit(f.date_to))
    if not f.show_hidden:
        keep.append(~F.col("hidden"))
    if f.only_interested:
        keep.append(F.col("interested"))
    if f.search:
        keep.append(any_of([F.coalesce(matches(c, f.search), F.lit(False))
                            for c in ("title", "artist", "venue")]))
    if f.genres:
        keep.append(any_of([matches("genre_tags", g) for g in f.genres]))
    for predicate in keep:
        listings = listings.where(predicate)
    return listings


def get_by_id(listings: DataFrame, listing_id: int) -> DataFrame:
    return listings.where(F.col("id") == listing_id)


def date_order() -> list[Column]:
    return [F.asc_nulls_first("event_date"), F.asc_nulls_first("event_time"), F.asc("id")]


def venue_order() -> list[Column]:
    return [ascii_lower("venue").asc_nulls_first(), F.asc_nulls_first("event_date"), F.asc("id")]


def relevance_order() -> list[Column]:
    """Best score first; ties keep the date order."""
    return [F.desc("score"), *date_order()]


def order_by(name: str | None) -> list[Column]:
    """Sort columns by name; anything unknown means date."""
    return {"venue": venue_order, "relevance": relevance_order}.get(name or "", date_order)()


def at_most(asked: int, most: int) -> int:
    """``asked``, or ``most`` with a warning: a caller who wants more rows sets the maximum."""
    if asked > most:
        warnings.warn(f"{asked} rows asked for; the maximum is {most}", stacklevel=3)
    return min(asked, most)


def page_bounds(page: int | None, page_size: int | None, most: int = MAX_PAGE) -> tuple[int, int]:
    return max(1, page or 1), at_most(max(1, page_size or DEFAULT_PAGE), most)


def page(listings: DataFrame, sort: str | None = None, page_no: int | None = None,
         page_size: int | None = None) -> DataFrame:
    """One page by number: top-(offset + size) per task, merged, then cut."""
    number, size = page_bounds(page_no, page_size)
    return listings.orderBy(*order_by(sort)).offset((number - 1) * size).limit(size)


def _holding(groups: DataFrame, offset: int) -> Row | None:
    """The (value, n, before) of the group that holds a row number; ``before`` counts the rows of earlier groups."""
    up_to = F.sum("n").over(Window.orderBy(F.asc_nulls_first("value")))
    placed = groups.withColumn("before", up_to - F.col("n"))
    return placed.where((F.col("before") <= offset) & (F.col("before") + F.col("n") > offset)).first()


def deep_page(listings: DataFrame, page_no: int | None = None, page_size: int | None = None, near: int = 10_000) -> DataFrame:
    """As ``page`` by date, for any depth: no task holds more than ``near`` rows and a page.

    Counts per day, then per time in the day that holds the page, tell where it begins, and ranges of ids narrow what is left. Each count reads only what the one before left over, and one row of it comes back. ``id`` must be
    unique and not null. A page past the end is empty.
    """
    number, size = page_bounds(page_no, page_size)
    skip = (number - 1) * size
    columns = [F.col("event_date"), F.col("event_time")]
    group, key = listings, []
    for column in columns:
        if skip <= near:
            break
        found = _holding(group.groupBy(column.alias("value")).agg(F.count("*").alias("n")), skip)
        if found is None:
            return listings.where(F.lit(False))
        skip -= found["before"]
        group = group.where(column.eqNullSafe(F.lit(found["value"])))
        key.append((column, found["value"], True))
    if len(key) == len(columns):
        low, high = group.agg(F.min("id"), F.max("id")).first()
        while skip > near and low < high:
            width = (high - low) // ID_RANGES + 1
            found = _holding(group.groupBy(F.floor((F.col("id") - low) / F.lit(width)).alias("value")).agg(F.count("*").alias("n")), skip)
            skip -= found["before"]
            low = low + int(found["value"]) * width
            high = min(high, low + width - 1)
            group = group.where(F.col("id").between(low, high))
        key.append((F.col("id"), low, True))
    # Rows at the key itself stay: they are what is skipped and the page.
    rest = listings if not key else listings.where(_past(key) | reduce(Column.__and__, [c.eqNullSafe(F.lit(v)) for c, v, _ in key]))
    return rest.orderBy(*date_order()).offset(skip).limit(size)


def _past(columns: list[tuple[Column, object, bool]]) -> Column:
    """Rows after a key in an order of (column, value, ascending); nulls come first, also in the key."""
    after = F.lit(False)
    for column, value, ascending in reversed(columns):
        same = column.eqNullSafe(F.lit(value))
        beyond = column.isNotNull() if value is None else (column > F.lit(value) if ascending else column < F.lit(value))
        after = beyond | (same & after)
    return F.coalesce(after, F.lit(False))


def page_after(listings: DataFrame, last: tuple, page_size: int | None = None, sort: str | None = None) -> DataFrame:
    """Next page after the last row seen, given by its sort key.

    The key is (event_date, event_time, id) in date order, (venue, event_date, id) in venue order, and
    (score, event_date, event_time, id) by relevance, over scored rows. Cost does not grow with depth:
    the key is a filter, so each task keeps only one page of rows. Use it instead of large page numbers.
    """
    date, clock, key = F.col("event_date"), F.col("event_time"), F.col("id")
    if sort == "venue":
        venue, day, row_id = last
        lowered = None if venue is None else "".join(c.lower() if c in string.ascii_uppercase else c for c in venue)
        order = [(ascii_lower("venue"), lowered, True), (date, day, True), (key, row_id, True)]
    elif sort == "relevance":
        score, day, time, row_id = last
        order = [(F.col("score"), score, False), (date, day, True), (clock, time, True), (key, row_id, True)]
    else:
        day, time, row_id = last
        order = [(date, day, True), (clock, time, True), (key, row_id, True)]
    size = page_bounds(1, page_size)[1]
    return listings.where(_past(order)).orderBy(*order_by(sort)).limit(size)


def count_listings(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count("*").alias("n"))


def page_meta(listings: DataFrame, page_no: int | None = None, page_size: int | None = None) -> DataFrame:
    number, size = page_bounds(page_no, page_size)
    return listings.agg(F.count("*").alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / size).cast("long").alias("pages"))


def facet_cities(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("city") != "").select("city").distinct().orderBy("city")


def facet_sources(listings: DataFrame) -> DataFrame:
    return listings.select("source_name").distinct().orderBy("source_name")


def facet_tags(listings: DataFrame) -> DataFrame:
    # Tag strings repeat far more than listings differ: reduce them first.
    texts = listings.select("genre_tags").distinct()
    return texts.select(F.explode(parse_tags("genre_tags")).alias("tag")).distinct().orderBy("tag")


def _facet_rows(combos: DataFrame) -> DataFrame:
    """(facet, value) rows, and the other columns, of combinations of tags, city and source."""
    rest = [c for c in combos.columns if c not in ("genre_tags", "city", "source_name")]
    pairs = F.array_append(F.array_append(
        F.transform(parse_tags("genre_tags"), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))),
        F.struct(F.lit("city").alias("facet"), F.col("city").alias("value"))),
        F.struct(F.lit("source").alias("facet"), F.col("source_name").alias("value")))
    rows = combos.select(*rest, F.explode(F.array_distinct(pairs)).alias("p")).select("p.*", *rest)
    empty_city = (F.col("facet") == "city") & (F.coalesce("value", F.lit("")) == "")
    return rows.where(~empty_city)


def facets_all(listings: DataFrame) -> DataFrame:
    """Every facet value in one pass over the table, as (facet, value) rows."""
    return _facet_rows(listings.select("genre_tags", "city", "source_name").distinct()).distinct().orderBy("facet", "value")


def facet_counts(listings: DataFrame) -> DataFrame:
    """(facet, value, n): listings per facet value; a tag a listing repeats counts once."""
    combos = listings.groupBy("genre_tags", "city", "source_name").agg(F.count("*").alias("n"))
    return _facet_rows(combos).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def facet_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch changes in ``facet_counts``, from the rows it touched as they were and as they are; new rows have no before."""
    return _sum_counts(facet_counts(before).withColumn("n", -F.col("n")).unionByName(facet_counts(after))).where("n <> 0")


def change_facets(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Kept facet counts after a batch, equal to a scan of the whole table; values nobody has any more go."""
    return _sum_counts(counts.unionByName(changes)).where("n > 0")


def _sum_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("facet", "value").agg(F.sum("n").alias("n"))

"""Calendar views, curated list and export. Every view takes its as-of day."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playbill.functions.text import truthy
from playbill.operators.filters import (
    Filters, apply_filters, at_most, date_order, order_by, page, page_after, relevance_order,
)
from playbill.operators.scoring import score_listings

TOP_DEFAULT, TOP_MAX, TOP_DAYS = 50, 100, 30
DAY_LABEL = "EEEE, MMM d"
#: Adds base, boost and score to listings; see ``scoring.scorer``.
Score = Callable[..., DataFrame]


def unscored(listings: DataFrame, few: bool = False) -> DataFrame:
    return listings


def tonight(listings: DataFrame, weights: DataFrame, decayed: DataFrame, as_of: dt.date,
            f: Filters = Filters()) -> DataFrame:
    today = apply_filters(listings, replace(f, date_from=as_of, date_to=as_of))
    return score_listings(today, weights, decayed).orderBy(*date_order())


def top_picks(listings: DataFrame, weights: DataFrame, decayed: DataFrame, as_of: dt.date,
              f: Filters = Filters(), limit: int | None = None, most: int = TOP_MAX) -> DataFrame:
    """Best scores of the next 30 days; listings without a match still count.

    Asking for more than ``most`` gives ``most``, with a warning.
    """
    window = replace(f, date_from=as_of, date_to=as_of + dt.timedelta(days=TOP_DAYS))
    scored = score_listings(apply_filters(listings, window), weights, decayed)
    return scored.orderBy(*relevance_order()).limit(at_most(limit or TOP_DEFAULT, most))


def scored_page(listings: DataFrame, score: Score, sort: str | None = None, page_no: int | None = None,
                page_size: int | None = None) -> DataFrame:
    """One page with scores. By date or venue only the page's rows are scored; by relevance all are, then the page is cut."""
    if sort == "relevance":
        return page(score(listings), sort, page_no, page_size)
    return score(page(listings, sort, page_no, page_size), few=True).orderBy(*order_by(sort))


def scored_page_after(listings: DataFrame, score: Score, last: tuple, page_size: int | None = None,
                      sort: str | None = None) -> DataFrame:
    """The page after a sort key, with scores; see ``page_after``."""
    if sort == "relevance":
        return page_after(score(listings), last, page_size, sort)
    return score(page_after(listings, last, page_size, sort), few=True).orderBy(*order_by(sort))


def week_days(listings: DataFrame, as_of: dt.date, f: Filters = Filters(), score: Score = unscored) -> DataFrame:
    """Listings of the Monday-to-Sunday week in date order, plus one bare row per empty day.

    Days are never joined to listings: seven keys would put a week on seven
    tasks. Only the distinct days present, at most seven, meet the calendar.
    """
    monday = as_of - dt.timedelta(days=as_of.weekday())
    sunday = monday + dt.timedelta(days=6)
    week = apply_filters(listings, replace(f, date_from=monday, date_to=sunday))
    spine = listings.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(monday), F.lit(sunday))).alias("event_date"))
    empty = spine.join(week.select("event_date").distinct(), "event_date", "left_anti")
    rows = score(week).unionByName(empty, allowMissingColumns=True)
    return rows.withColumn("label", F.date_format("event_date", DAY_LABEL)).orderBy(*date_order())


def week_counts(listings: DataFrame, as_of: dt.date, f: Filters = Filters()) -> DataFrame:
    rows = week_days(listings, as_of, f)
    return rows.groupBy("event_date", "label").agg(F.count("id").alias("n")).orderBy("event_date")


def curated(listings: DataFrame, document: DataFrame, score: Score = unscored) -> DataFrame:
    """Listings named by curated lists, in list order, with the stated reason.

    Missing and hidden listings drop out. Any number of list documents is
    accepted; ``doc_id`` tells them apart.
    """
    wanted = document.select("doc_id", F.posexplode("events").alias("pos", "e")).select(
        "doc_id", "pos", F.col("e.id").alias("id"), truthy(F.col("e.reason")).alias("reason"))
    return score(wanted.join(listings.where(~F.col("hidden")), "id")).orderBy("doc_id", "pos")


def month_of(text: str | None, as_of: dt.date) -> tuple[dt.date, dt.date] | None:
    """First and last day of ``YYYY-MM``; text of another shape means the as-of
    month, and a month that does not exist gives None."""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}", text or ""):
        year, month = as_of.year, as_of.month
    else:
        year, month = int(text[:4]), int(text[5:])
    if not (1 <= month <= 12 and year >= 1):
        return None
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def month_listings(listings: DataFrame, month: str | None, as_of: dt.date, f: Filters = Filters(),
                   score: Score = unscored) -> DataFrame:
    span = month_of(month, as_of)
    if span is None:
        return score(listings.where(F.lit(False)))
    return score(apply_filters(listings, replace(f, date_from=span[0], date_to=span[1])))


def month_counts(listings: DataFrame, month: str | None, as_of: dt.date, f: Filters = Filters()) -> DataFrame:
    rows = month_listings(listings, month, as_of, f)
    return rows.groupBy("event_date").agg(F.count("*").alias("n")).orderBy("event_date")


def month_grid(listings: DataFrame, month: str | None, as_of: dt.date, f: Filters = Filters()) -> DataFrame:
    """Monday-first calendar cells: leading blanks, then every day with its count.

    ``selected`` marks as_of when it has listings, else the first day that does.
    At most 37 rows, so the unpartitioned window is one small task.
    """
    span = month_of(month, as_of)
    if span is None:
        raise ValueError(f"no such month: {month}")
    first, last = span
    days = listings.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("event_date"))
    filled = days.join(month_counts(listings, month, as_of, f), "event_date", "left").select(
        "event_date", F.coalesce("n", F.lit(0)).alias("n"))
    choice = F.min(F.when(F.col("n") > 0, F.struct(F.col("event_date") != F.lit(as_of), "event_date")))
    marked = filled.withColumn("choice", choice.over(W.partitionBy(F.lit(0))))
    cells = marked.select(
        (F.dayofmonth("event_date") + first.weekday()).alias("cell"), "event_date",
        F.dayofmonth("event_date").alias("day"), "n",
        F.coalesce(F.col("choice.event_date") == F.col("event_date"), F.lit(False)).alias("selected"))
    if first.weekday() == 0:
        return cells.orderBy("cell")
    blanks = listings.sparkSession.range(1, first.weekday() + 1).select(
        F.col("id").cast("int").alias("cell"), F.lit(False).alias("selected"))
    return cells.unionByName(blanks, allowMissingColumns=True).orderBy("cell")


def export_upcoming(listings: DataFrame, weights: DataFrame, decayed: DataFrame, as_of: dt.date) -> DataFrame:
    """Visible listings from as_of on, 13 columns, score to two decimals."""
    upcoming = apply_filters(listings, Filters(date_from=as_of))
    scored = score_listings(upcoming, weights, decayed)
    return scored.select(
        "id", "title", "artist", "venue", "city", F.col("event_date").alias("date"),
        F.col("event_time").alias("time"), "category", "genre_tags", "price_range", "ticket_url",
        "interested", F.round("score", 2).alias("score"))



def export_header(export: DataFrame, as_of: dt.date) -> DataFrame:
    """One row that goes with an export: when it was made and how many listings it holds."""
    return export.agg(F.count("*").alias("count")).select(F.lit(as_of.isoformat()).alias("generated_at"), "count")

"""Calendar export of interested listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf, moment
from playbill.functions.text import col, truthy

CRLF = "\r\n"


def ics_escape(c: Column | str) -> Column:
    """Escape backslash, semicolon, comma and line breaks, in that order."""
    text = F.coalesce(col(c), F.lit(""))
    for raw, code in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def vevent(as_of: AsOf, uid: str = "listing") -> Column:
    """One listing as a VEVENT block: timed when it has a time, else all-day."""
    day = F.date_format("event_date", "yyyyMMdd")
    start = F.when(F.col("event_time").rlike(r"^\d{2}:\d{2}"), F.concat(
        F.lit("DTSTART:"), day, F.lit("T"), F.replace(F.left("event_time", F.lit(5)), F.lit(":"), F.lit("")),
        F.lit("00"))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), day))
    place = F.concat_ws(", ", truthy("venue"), truthy("city"))

    def labelled(label: str, c: str) -> Column:
        return F.concat(F.lit(f"{label}: "), truthy(c))

    about = F.concat_ws("\n", labelled("Artist", "artist"), labelled("Genres", "genre_tags"),
                        labelled("Price", "price_range"), labelled("Tickets", "ticket_url"))
    stamp = F.date_format(moment(as_of), "yyyyMMdd'T'HHmmss'Z'")
    # concat_ws skips nulls, so absent lines leave no gap.
    return F.concat_ws(
        CRLF, F.lit("BEGIN:VEVENT"),
        F.concat(F.lit(f"UID:{uid}-"), F.col("id").cast("string"), F.lit("@localhost")),
        F.concat(F.lit("DTSTAMP:"), stamp), start, F.concat(F.lit("SUMMARY:"), ics_escape("title")),
        F.when(place != "", F.concat(F.lit("LOCATION:"), ics_escape(place))),
        F.when(about != "", F.concat(F.lit("DESCRIPTION:"), ics_escape(about))),
        F.when(F.col("ticket_url") != "", F.concat(F.lit("URL:"), ics_escape("ticket_url"))),
        F.lit("END:VEVENT"))


def ics_rows(listings: DataFrame, as_of: AsOf, uid: str = "listing") -> DataFrame:
    """VEVENTs of interested listings, hidden ones included, with their sort key."""
    return listings.where("interested").select("event_date", "event_time", "id", vevent(as_of, uid).alias("vevent"))


def ics_lines(listings: DataFrame, as_of: AsOf, name: str = "Interested", product: str = "-//playbill//EN") -> DataFrame:
    """The whole calendar in order: header, events by date and time, footer.

    The sort is a range partition over all tasks; files in part order are the
    calendar.
    """
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "CALSCALE:GREGORIAN"]
    session = listings.sparkSession
    header = session.range(1).select(F.lit(0).alias("part"), F.concat(
        F.lit(CRLF.join(head) + CRLF + "X-WR-CALNAME:"), ics_escape(F.lit(name))).alias("vevent"))
    footer = session.range(1).select(F.lit(2).alias("part"), F.lit("END:VCALENDAR").alias("vevent"))
    body = ics_rows(listings, as_of).withColumn("part", F.lit(1))
    lines = body.unionByName(header, allowMissingColumns=True).unionByName(footer, allowMissingColumns=True)
    return lines.orderBy("part", "event_date", F.asc_nulls_first("event_time"), "id").select("vevent")


def write_ics(listings: DataFrame, path: str, as_of: AsOf, name: str = "Interested") -> None:
    ics_lines(listings, as_of, name).write.mode("overwrite").option("lineSep", CRLF).text(path)

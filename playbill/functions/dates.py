"""Date and time expressions.

Nothing here reads a clock: every rule that depends on "now" takes ``as_of``,
and every rule that depends on a place takes ``zone``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import SPACE, col, let, strip

# The date grammar accepted in listing text.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
    "aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
UTC_INSTANT = r"(?i)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z"
ISO_DAY = r"(\d{4})-(\d{2})-(\d{2})"
SLASHED = r"(?:^|[^\d])(\d{1,2})/(\d{1,2})(?:[/-](\d{2,4}))?(?!\d)"
MONTH_FIRST = (
    rf"(?i)(?:^|[^a-z])({MONTH})\.?{SPACE}+(\d{{1,2}})(?!\d)(?:st|nd|rd|th)?"
    rf"(?:,?{SPACE}+(\d{{4}}))?"
)
DAY_FIRST = (
    rf"(?i)(?:^|[^\d])(\d{{1,2}})(?:st|nd|rd|th)?{SPACE}+({MONTH})\.?"
    rf"(?:,?{SPACE}+(\d{{4}}))?"
)
CLOCK_ISO = r"T(\d{2}):(\d{2})"
CLOCK_12H = rf"(?i)(?<![a-z0-9_])(\d{{1,2}})(?::(\d{{2}}))?{SPACE}*([ap])\.?m(?![a-z0-9_])"
CLOCK_24H = r"(?<![A-Za-z0-9_])([01]?\d|2[0-3]):([0-5]\d)(?![A-Za-z0-9_])"
GRACE_DAYS = 45

# Shapes taken by the last-resort rule; anything else is not a date.
LONE_YEAR = r"^(\d{4})$"
YEAR_MONTH = r"^(\d{4})-(\d{2})$"
WORDS_YEAR = r"^[^\d(]*[^\dA-Za-z(](\d{4})$"
MONTH_WORD = r"(?i)(?:^|.*[^a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DASHED = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"

AsOf = dt.date | dt.datetime | str | Column


def moment(as_of: AsOf) -> Column:
    """``as_of`` as a zone-free timestamp; a bare date means its midnight."""
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp_ntz")


def day(as_of: AsOf) -> Column:
    return moment(as_of).cast("date")


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(c, pattern, n)


def valid_ymd(y: Column, m: Column, d: Column) -> Column:
    """The DATE for a real calendar day, else null."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"),
                       F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    # Two-digit years mean the 1900s to the source grammar and never match back.
    return F.when((y >= 100) & (y <= 9999) & (m <= 99) & (d <= 99), text.try_cast("date"))


def plausible_year(y: Column, as_of: AsOf) -> Column:
    """Listings are near-term: last year up to two years ahead."""
    this_year = F.year(day(as_of))
    return y.between(this_year - 1, this_year + 2)


def infer_year(m: Column, d: Column, as_of: AsOf) -> Column:
    """Year of a month/day without one: this year, or the next when the day
    lies more than 45 days back. The cutoff keeps the clock time of ``as_of``."""
    now = moment(as_of)
    year = F.year(now)
    start = F.make_date(year, F.lit(1), F.lit(1))
    # Overlong days roll into the next month, as 29 February does off leap years.
    candidate = F.date_add(F.add_months(start, m - 1), d - 1).cast("timestamp_ntz")
    cutoff = now - F.expr(f"interval {GRACE_DAYS} days")
    return F.when(candidate < cutoff, year + 1).otherwise(year)


def local_instant(text: Column, zone: str) -> Column:
    """The first ``...Z`` instant inside a text as local wall-clock time."""
    found = F.upper(_group(text, UTC_INSTANT, 0))
    utc = F.regexp_replace(found, "Z$", "").try_cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))


def _checked(parts: Column, as_of: AsOf) -> Column:
    """Date of a (y, m, d) struct; a null year is inferred first."""
    def full(p: Column) -> Column:
        year = F.coalesce(p["y"], infer_year(p["m"], p["d"], as_of))
        return _ymd(year, p["m"], p["d"])

    return let(let(parts, full), lambda p: F.when(
        plausible_year(p["y"], as_of), valid_ymd(p["y"], p["m"], p["d"])))


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")


def _last_resort(text: Column, as_of: AsOf, zone: str) -> Column:
    """Year-only and year-month texts, dashed M-D-YYYY, and words plus a year."""
    def utc_midnight(y: Column, m: Column) -> Column:
        first = valid_ymd(y, m, F.lit(1)).cast("timestamp_ntz")
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), first).cast("date")

    def part(pattern: str, n: int) -> Column:
        return _group(text, pattern, n).try_cast("int")

    month_word = F.regexp_extract(text, MONTH_WORD, 1)
    month = F.when(month_word != "", _month_number(month_word)).otherwise(F.lit(1))
    guess = (F.when(text.rlike(LONE_YEAR), utc_midnight(part(LONE_YEAR, 1), F.lit(1)))
             .when(text.rlike(YEAR_MONTH), utc_midnight(part(YEAR_MONTH, 1), part(YEAR_MONTH, 2)))
             .when(text.rlike(DASHED), valid_ymd(part(DASHED, 3), part(DASHED, 1), part(DASHED, 2)))
             .when(text.rlike(WORDS_YEAR), valid_ymd(part(WORDS_YEAR, 1), month, F.lit(1))))
    return let(guess, lambda g: F.when(plausible_year(F.year(g), as_of), g))


def parse_date(c: Column | str, as_of: AsOf, zone: str = "UTC") -> Column:
    """DATE found in a loose text, or null.

    The first rule whose shape occurs decides, even when its check then fails;
    only an impossible ``...Z`` instant falls through to the next rule.
    """
    def rules(text: Column) -> Column:
        def number(pattern: str, n: int) -> Column:
            return _group(text, pattern, n).try_cast("int")

        short = number(SLASHED, 3)
        slashed = _ymd(F.when(short < 100, short + 2000).otherwise(short),
                       number(SLASHED, 1), number(SLASHED, 2))
        month_first = _ymd(number(MONTH_FIRST, 3), _month_number(_group(text, MONTH_FIRST, 1)),
                           number(MONTH_FIRST, 2))
        day_first = _ymd(number(DAY_FIRST, 3), _month_number(_group(text, DAY_FIRST, 2)),
                         number(DAY_FIRST, 1))
        later = (F.when(text.rlike(ISO_DAY), valid_ymd(*[number(ISO_DAY, n) for n in (1, 2, 3)]))
                 .when(text.rlike(SLASHED), _checked(slashed, as_of))
                 .when(text.rlike(MONTH_FIRST), _checked(month_first, as_of))
                 .when(text.rlike(DAY_FIRST), _checked(day_first, as_of))
                 .otherwise(_last_resort(text, as_of, zone)))
        return (F.when(text.rlike(UTC_INSTANT),
                       F.coalesce(local_instant(text, zone).cast("date"), later))
                .otherwise(later))

    # Every rule needs a digit, so text without one is done after one look.
    return F.when(col(c).rlike("[0-9]"), let(strip(col(c)), rules))


def parse_time(c: Column | str, zone: str = "UTC") -> Column:
    """``HH:MM`` (24 h) found in a loose text, or null."""
    def clock(h: Column, m: Column) -> Column:
        return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), m)

    def rules(text: Column) -> Column:
        hour12 = _group(text, CLOCK_12H, 1).try_cast("int") % 12
        noon = F.when(F.lower(_group(text, CLOCK_12H, 3)) == "p", 12).otherwise(0)
        minute = F.coalesce(F.nullif(_group(text, CLOCK_12H, 2), F.lit("")), F.lit("00"))
        later = (F.when(text.rlike(CLOCK_ISO), clock(_group(text, CLOCK_ISO, 1), _group(text, CLOCK_ISO, 2)))
                 .when(text.rlike(CLOCK_12H), clock(hour12 + noon, minute))
                 .when(text.rlike(CLOCK_24H), clock(_group(text, CLOCK_24H, 1), _group(text, CLOCK_24H, 2))))
        return F.when(text.rlike(UTC_INSTANT), F.coalesce(
            F.date_format(local_instant(text, zone), "HH:mm"), later)).otherwise(later)

    return F.when(col(c).rlike("[0-9]"), let(col(c), rules))


def local_day(instant: Column, zone: str) -> Column:
    """Calendar day of a UTC wall-clock value in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz")).cast("date")


def week_start(d: Column) -> Column:
    """Monday of the week holding the day."""
    return F.date_trunc("week", d).cast("date")


def week_end(d: Column) -> Column:
    return F.date_add(week_start(d), 6)

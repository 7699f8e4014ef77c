"""Text expressions: whitespace, accent folding, keys, slugs, categories.

Everything here returns a Column built from JVM-side functions, so it stays
inside the scan's stage and never ships rows to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whitespace set of the listing text rules.
SPACES = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]"
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x10000) if re.fullmatch(SPACE, chr(c)))

# Words that mark a listing as comedy or music.
COMEDY_HINTS = [
    "comedy", "comedian", "stand-up", "standup", "stand up", "improv",
    "open mic comedy",
]
MUSIC_HINTS = [
    "music", "concert", "band", "live music", "dj", "tour", "acoustic",
    "rock", "jazz", "hip hop", "rap", "punk", "metal", "folk", "electronic",
    "indie", "orchestra", "symphony",
]

TITLE_LIMIT = 300


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Keeps expressions that use one intermediate many times from growing
    exponentially when they nest.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def project_where(df: DataFrame, keep: list[str], fields: dict[str, Column],
                  test: Callable[[Column], Column]) -> DataFrame:
    """Computed fields of the rows that pass a test on them.

    A filter written after the projection is pushed below it and evaluates the
    parsing a second time; this form evaluates it once per row.
    """
    record = F.struct(*[c.alias(name) for name, c in fields.items()])
    return df.select(*keep, F.inline(F.filter(F.array(record), test)))


def truthy(c: Column | str) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode space from both ends."""
    return F.btrim(col(c), F.lit(SPACE_CHARACTERS))


def squash(c: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{SPACE}+", " "))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII word characters.

    Derived from the Unicode database instead of being listed: the first two
    strings feed ``translate``; the dict holds the few that expand to several.
    """
    source, target, expand = [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kept = "".join(
            d for d in unicodedata.normalize("NFKD", ch)
            if d.isascii() and (d.isalnum() or d in "_ ")
        )
        if len(kept) == 1:
            source.append(ch)
            target.append(kept)
        elif kept:
            expand[ch] = kept
    return "".join(source), "".join(target), expand


def _ranges(chars: dict[str, str]) -> list[str]:
    """A few character ranges that cover the given characters.

    They may cover neighbours too: a short class is tested much faster than a
    list of hundreds, and expanding a character without an entry keeps it.
    """
    spans: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if spans and cp - spans[-1][1] < 16:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return [f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans]


def _expanded(text: Column, expand: dict[str, str]) -> Column:
    """Spell out ligatures, fractions and the like; rare, so per character only there."""
    table = F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in expand.items())), F.lit(","), F.lit("="))
    letters = F.transform(F.split(text, ""), lambda x: F.when(
        x > "\x7f", F.coalesce(F.try_element_at(table, x), x)).otherwise(x))
    several = "[" + "".join(_ranges(expand)) + "]"
    return F.when(text.rlike(several), F.array_join(letters, "")).otherwise(text)


def norm(c: Column | str) -> Column:
    """Key form of a text: lower, fold accents (NFKD), drop punctuation, squash.

    One ``translate`` folds single letters, turns every space into a blank and
    drops ASCII punctuation; only text that still holds other characters needs
    more.
    """
    source, target, expand = _folding()
    dropped = "".join(chr(i) for i in range(0x80) if not (chr(i).isalnum() or chr(i) in "_" + SPACE_CHARACTERS))
    spaces = "".join(ch for ch in SPACE_CHARACTERS if ch not in source)
    plain = F.translate(F.lower(F.coalesce(col(c), F.lit(""))),
                        source + spaces + dropped, target + " " * len(spaces))
    ascii_only = let(plain, lambda x: F.when(
        x.rlike(r"[^\x00-\x7f]"), F.regexp_replace(_expanded(x, expand), r"[^A-Za-z0-9_ ]+", "")).otherwise(x))
    return F.trim(F.regexp_replace(ascii_only, " {2,}", " "))


def dedupe_key(title: Column | str, day: Column | str, venue: Column | str) -> Column:
    """``norm(title)|first ten characters of the day|norm(venue)``."""
    ten = F.substring(F.coalesce(col(day).cast("string"), F.lit("")), 1, 10)
    return F.concat_ws("|", norm(title), ten, norm(venue))


def slug(c: Column | str) -> Column:
    """URL-safe id of a name, at most 40 characters."""
    dashed = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-|-$", ""), F.lit(40))


def slug_loose(c: Column | str) -> Column:
    """The variant used for user-saved sources: no edge strip, no cut."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")


def _mentions(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def classify(c: Column | str, fallback: Column | str | None = "other") -> Column:
    """comedy / music by substring hints (comedy first), else the fallback.

    ``fallback`` is a Column, or a plain word, or None for null.
    """
    other = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("string")
    return let(F.lower(F.coalesce(col(c), F.lit(""))), lambda text: F.when(
        _mentions(text, COMEDY_HINTS), "comedy").when(_mentions(text, MUSIC_HINTS), "music").otherwise(other))


def category_clamp(c: Column | str) -> Column:
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(lowered.isin("music", "comedy"), lowered).otherwise(F.lit("other"))


def parse_tags(c: Column | str) -> Column:
    """Comma-joined tags to an array: trimmed, lowered, blanks dropped."""
    parts = F.split(F.coalesce(col(c), F.lit("")), ",")
    return F.filter(F.transform(parts, lambda t: F.lower(strip(t))), lambda t: t != "")


def token_match(a: Column | str, b: Column | str) -> Column:
    """True when either text contains the other; empty text never matches."""
    a, b = col(a), col(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))

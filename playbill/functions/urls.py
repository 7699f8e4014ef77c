"""URL expressions: guard, resolve, normalise. Only http(s) ever survives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import col, let, strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
WEB = r"(?i)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# Already canonical: lowercase host, plain path without dot segments, simple query.
PLAIN = (r"^https?://[a-z0-9\-]+(?:\.[a-z0-9\-]+)*(?:(?:/[A-Za-z0-9_~\-][A-Za-z0-9_~.\-]*)+/?|/)"
         r"(?:\?[A-Za-z0-9_~.=&%\-]+)?$")
HOST_PORT = r"^(?:.*@)?(.*?)(?::(\d*))?$"
BAD_HOST = r"[\x00-\x20\x7f<>^|%:\[\]\\]"

# Characters percent-encoded in each part of a URL.
PATH_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"),
                ("{", "%7B"), ("}", "%7D")]
QUERY_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("'", "%27")]
FRAGMENT_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60")]


def _tidy(c: Column) -> Column:
    """Drop edge controls and spaces, then tabs and line breaks anywhere."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def _escape(part: Column, table: list[tuple[str, str]]) -> Column:
    for raw, code in table:
        part = F.replace(part, F.lit(raw), F.lit(code))

    def spelled(text: Column) -> Column:
        letters = F.transform(F.split(text, ""), lambda x: F.when(
            x.rlike(r"[^\x00-\x7f]"), F.url_encode(x)).otherwise(x))
        return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(letters, "")).otherwise(text)

    return let(part, spelled)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (F.when(segment == ".", kept).when(segment == "..", shorter)
                .otherwise(F.array_append(kept, segment)))

    def walked(p: Column) -> Column:
        # The text before the leading slash is empty and is not a segment.
        segments = F.split(F.substr(p, F.lit(2)), "/")
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        return let(kept, lambda k: F.concat(
            F.lit("/"), F.array_join(k, "/"),
            F.when(p.rlike(r"/\.\.?$") & (F.size(k) > 0), "/").otherwise("")))

    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), walked(p)).otherwise(p))


def _normal(url: Column) -> Column:
    """Canonical text of an absolute http(s) URL, null for anything else."""
    def split_up(u: Column) -> Column:
        server = F.regexp_extract(u, WEB, 2)
        return F.struct(
            F.lower(F.regexp_extract(u, WEB, 1)).alias("scheme"),
            F.regexp_extract(server, "^(.*@)?", 1).alias("user"),
            F.lower(F.regexp_extract(server, HOST_PORT, 1)).alias("host"),
            F.regexp_extract(server, HOST_PORT, 2).alias("port"),
            F.replace(F.regexp_extract(u, WEB, 3), F.lit("\\"), F.lit("/")).alias("path"),
            F.regexp_extract(u, WEB, 4).alias("query"),
            F.regexp_extract(u, WEB, 5).alias("fragment"))

    def rebuilt(p: Column) -> Column:
        number = p["port"].try_cast("int")
        usual = F.when(p["scheme"] == "http", 80).otherwise(443)
        port = F.when((p["port"] == "") | (number == usual), "").otherwise(
            F.concat(F.lit(":"), number.cast("string")))
        path = F.when(p["path"] == "", "/").otherwise(_resolve_dots(_escape(p["path"], PATH_ESCAPES)))
        good = ((p["host"] != "") & ~p["host"].rlike(BAD_HOST)
                & ((p["port"] == "") | number.between(0, 65535)))
        return F.when(good, F.concat(
            p["scheme"], F.lit("://"), p["user"], p["host"], port, path,
            _escape(p["query"], QUERY_ESCAPES), _escape(p["fragment"], FRAGMENT_ESCAPES)))

    return let(url, lambda u: F.when(u.rlike(PLAIN), u).when(u.rlike(WEB), let(split_up(u), rebuilt)))


def url_guard(c: Column | str) -> Column:
    """An absolute http(s) URL in canonical form, else null."""
    return F.when(col(c).rlike(PLAIN), col(c)).otherwise(_normal(_tidy(col(c))))


def abs_url(href: Column | str, base: Column | str) -> Column:
    """Resolve ``href`` on ``base``; http(s) results only, else null."""
    def joined(x: Column) -> Column:
        link, page = x["link"], x["page"]
        plain = F.replace(link, F.lit("\\"), F.lit("/"))
        bare = F.regexp_extract(page, "^([^?#]*)", 1)
        return (F.when(link.rlike(SCHEME), link)
                .when(plain.startswith("//"), F.concat(F.regexp_extract(page, "^(https?:)", 1), plain))
                .when(plain.startswith("/"), F.concat(F.regexp_extract(page, "^(https?://[^/?#]*)", 1), plain))
                .when(link.startswith("?"), F.concat(bare, link))
                .when(link.startswith("#"), F.concat(F.regexp_extract(page, "^([^#]*)", 1), link))
                .when(link == "", F.regexp_extract(page, "^([^#]*)", 1))
                .otherwise(F.concat(F.regexp_extract(bare, "^(.*/)", 1), plain)))

    parts = F.struct(_tidy(col(href)).alias("link"), url_guard(base).alias("page"))
    return let(parts, lambda x: F.when(
        x["page"].isNotNull() & (col(href) != ""), _normal(joined(x))))


def normalize_url(c: Column | str) -> Column:
    """A user-typed address: ``https://`` is assumed; null when invalid."""
    text = strip(col(c))
    return F.when(text != "", url_guard(
        F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))))


def host_of(c: Column | str) -> Column:
    """Host name of a URL without a leading ``www.``; null when not a URL."""
    host = F.regexp_extract(url_guard(c), r"^https?://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))

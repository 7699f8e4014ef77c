"""Events embedded in web pages as JSON-LD.

A page's JSON is walked inside one expression: an aggregate over the depth
levels moves a frontier of variants down and collects event nodes, so a page
costs one narrow stage. How many levels there are is read off each block's own
brackets, so no depth is out of reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf, parse_date, parse_time
from playbill.functions.text import classify, let, project_where, squash, truthy
from playbill.functions.urls import abs_url

# Fixed value: where JSON-LD stands in a page.
SCRIPT = r"(?i)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"
SAMPLE = 5
LAYERS = 8


def nesting(body: Column) -> Column:
    """How deep objects and arrays are nested in a JSON text; brackets inside its strings do not count.

    Empty pairs of brackets are taken away layer by layer. What has more layers than most pages have is read bracket by bracket.
    """
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*"|[^\[\]{}"]+', "")
    peeled = F.aggregate(
        F.sequence(F.lit(1), F.lit(LAYERS)), F.struct(F.translate(bare, "[]", "{}").alias("rest"), F.lit(0).alias("most")),
        lambda acc, _: F.struct(F.replace(acc["rest"], F.lit("{}"), F.lit("")).alias("rest"),
                                (acc["most"] + F.when(acc["rest"] != "", 1).otherwise(0)).alias("most")))

    def count(brackets: Column) -> Column:
        step = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
        return F.aggregate(F.split(brackets, ""), step, lambda acc, c: let(
            acc["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0),
            lambda at: F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"))), lambda acc: acc["most"])

    # What is left over is the outer layers.
    return let(peeled, lambda p: p["most"] + F.when(p["rest"] == "", 0).otherwise(count(p["rest"])))


def jsonld_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Parsed JSON-LD blocks with their place on the page and their ``depth``; malformed ones are skipped."""
    bodies = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(bodies).alias("block", "body"))
    return rows.withColumns({"doc": F.try_parse_json(F.trim("body")), "depth": nesting(F.col("body"))}).where(
        F.col("doc").isNotNull()).drop("body")


def _walk(doc: str, depth: str) -> str:
    """SQL for the array of (v, path) event nodes of the levels 0 to ``depth``, parents before children.

    Objects and arrays both count as a level. ``path`` orders the nodes; the
    fields of one object follow the variant's own field order.
    """
    kids = ("coalesce(map_values(try_variant_get(n.v, '$', 'map<string,variant>')), "
            "try_variant_get(n.v, '$', 'array<variant>'), cast(array() as array<variant>))")
    kind = "try_variant_get(n.v, '$[\"@type\"]', 'variant')"
    is_event = (f"(schema_of_variant({kind}) = 'STRING' AND cast({kind} as string) rlike '(?i)event') "
                f"OR exists(coalesce(try_variant_get(n.v, '$[\"@type\"]', 'array<variant>'), cast(array() as array<variant>)), "
                f"t -> schema_of_variant(t) = 'STRING' AND cast(t as string) rlike '(?i)event')")
    node = "struct<v: variant, path: array<int>>"
    return f"""
      aggregate(sequence(0, cast({depth} as int)),
        named_struct('front', array(named_struct('v', {doc}, 'path', cast(array() as array<int>))),
                     'found', cast(array() as array<{node}>)),
        (acc, depth) -> named_struct(
          'front', flatten(transform(acc.front, n -> transform({kids}, (c, i) ->
                     named_struct('v', c, 'path', array_append(n.path, i))))),
          'found', concat(acc.found, filter(acc.front, n -> coalesce({is_event}, false)))),
        acc -> array_sort(acc.found, (a, b) ->
          case when a.path < b.path then -1 when a.path > b.path then 1 else 0 end))"""


def jsonld_event_nodes(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    """Every object whose ``@type`` mentions Event, with its ``place`` in its block and the ``path`` of positions to it.

    All depths are searched, unless a caller sets a ``limit``; ``truncated_blocks`` tells what that leaves out.
    """
    rest = [c for c in blocks.columns if c not in ("doc", "depth")]
    depth = "depth" if limit is None else f"least(depth, {int(limit)})"
    return blocks.select(*rest, F.posexplode(F.expr(_walk("doc", depth))).alias("place", "n")).select(
        *rest, "place", F.col("n.path").alias("path"), F.col("n.v").alias("node"))


def truncated_blocks(blocks: DataFrame, limit: int) -> DataFrame:
    """Blocks that are nested deeper than a limit, with the reason."""
    # An object at level n stands inside n others.
    rest = [c for c in blocks.columns if c not in ("doc", "depth")]
    return blocks.where(F.col("depth") > limit + 1).select(
        *rest, F.concat(F.lit("truncated: nested "), F.col("depth"), F.lit(f" deep, searched to {int(limit)}")).alias("reason"))


def _text(path: str) -> Column:
    """Scalar at a path as text, null when absent, empty or not a scalar."""
    value = F.try_variant_get("node", path, "variant")
    scalar = ~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY|VOID)")
    # Whole numbers print without a fraction.
    text = F.regexp_replace(F.try_variant_get("node", path, "string"), r"^(-?\d+)\.0$", "$1")
    return F.when(scalar, truthy(text))


def _first(name: str, field: str = "") -> Column:
    """A field of a node that may be one object or a list of them."""
    return F.coalesce(_text(f"$.{name}{field}"), _text(f"$.{name}[0]{field}"))


def _price() -> Column:
    """Offer price; a numeric zero counts as absent, the text '0' does not."""
    def of(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("node", path, "variant"))
        text = _text(path)
        return F.when((kind == "STRING") | (text.try_cast("double") != 0), text)

    return F.coalesce(of("$.offers.price"), of("$.offers[0].price"))


def map_jsonld(nodes: DataFrame, as_of: AsOf, zone: str, keep: list[str], base: str = "url", every: bool = False) -> DataFrame:
    """Event nodes to listing fields; nodes without a date or title are dropped, or kept if ``every`` row shall stay."""
    start = F.coalesce(_text("$.startDate"), _text("$.startTime"))
    types = F.coalesce(_text('$["@type"]'), F.array_join(
        F.try_variant_get("node", '$["@type"]', "array<string>"), " "))
    title = truthy(squash(_text("$.name")))
    flat = nodes.select(
        *keep, F.col(base).alias("base_url"), title.alias("title"),
        truthy(squash(_text("$.performer.name"))).alias("artist"),
        truthy(squash(_first("location", ".name"))).alias("venue"),
        truthy(squash(F.coalesce(_first("location", ".address"), _first("location", ".address.addressLocality")))).alias("city"),
        start.alias("start"), _text("$.doorTime").alias("door"), F.coalesce(types, F.lit("")).alias("types"),
        F.coalesce(_text("$.description"), F.lit("")).alias("about"),
        F.coalesce(_first("offers", ".url"), _text("$.url")).alias("link"),
        F.coalesce(_text("$.image"), _text("$.image.url"), _text("$.image[0]"), _text("$.image[0].url")).alias("image"),
        _price().alias("price"))
    titled = flat if every else flat.where(F.col("title").isNotNull())
    return project_where(titled, [*keep, "title", "artist", "venue", "city"], {
        "date": parse_date("start", as_of, zone), "time": parse_time("start", zone),
        "doors_time": parse_time("door", zone),
        "category": classify(F.concat_ws(" ", "types", "title", "about"), None), "genre_tags": F.lit(""),
        "ticket_url": abs_url("link", "base_url"), "image_url": abs_url("image", "base_url"),
        "price_range": F.concat(F.lit("$"), F.col("price")),
    }, lambda r: F.lit(True) if every else r["date"].isNotNull())


def jsonld_listings(pages: DataFrame, as_of: AsOf, zone: str = "UTC") -> DataFrame:
    """Listings of all pages, with (page_id, block, place) as their position."""
    nodes = jsonld_event_nodes(jsonld_blocks(pages))
    return map_jsonld(nodes, as_of, zone, ["page_id", "block", "place"])


def _first_events(made: Column) -> list[Column]:
    """Aggregates over a page's rows: how many listings there are, and the first of them in page order."""
    row = F.struct("block", "place", "title", "date")
    return [F.count_if(made).alias("n"), F.slice(F.array_sort(F.collect_list(F.when(made, row))), 1, SAMPLE).alias("sample")]


def jsonld_sample(listings: DataFrame) -> DataFrame:
    """Per page: how many events, and the first five. One pass and one shuffle of narrow rows."""
    pages = listings.groupBy("page_id").agg(*_first_events(F.lit(True)))
    rows = pages.select("page_id", "n", F.posexplode("sample").alias("at", "e"))
    return rows.select("page_id", (F.col("at") + 1).alias("rank"), "e.title", "e.date", "n")


def page_summary(pages: DataFrame, as_of: AsOf, zone: str, carry: dict[str, Column]) -> DataFrame:
    """Per page ``n`` listings, the ``sample`` of the first five, and the ``carry`` columns, from one reading of its text.

    Pages without JSON-LD have n = 0. ``carry`` is computed beside the walk, so the text goes no further.
    """
    bodies = F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))
    read = pages.select("page_id", "url", *[c.alias(name) for name, c in carry.items()], bodies.alias("bodies"))
    base = read.select("page_id", "url", *carry, F.posexplode_outer("bodies").alias("block", "body"))
    docs = base.withColumns({"doc": F.try_parse_json(F.trim("body")), "depth": nesting(F.col("body"))}).drop("body")
    keep = ["page_id", "url", *carry, "block"]
    nodes = docs.select(*keep, F.posexplode_outer(F.when(F.col("doc").isNotNull(), F.expr(_walk("doc", "depth")))).alias("place", "n")).select(
        *keep, "place", F.col("n.v").alias("node"))
    rows = map_jsonld(nodes, as_of, zone, [*keep, "place"], every=True)
    made = F.col("title").isNotNull() & F.col("date").isNotNull()
    return rows.groupBy("page_id", "url").agg(*[F.any_value(c).alias(c) for c in carry], *_first_events(made))

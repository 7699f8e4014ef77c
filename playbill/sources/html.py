"""Listings scraped from page markup with configured selectors.

Markup has no JVM-side reader in Spark, so this is the one Python step: pages
stream through ``mapInArrow`` in batches, each page is parsed and
released, and only the few raw fields per item go back to the JVM.

Selectors may use tags, ``.class``, ``#id``, ``[attr]``, ``[attr='x']``,
``[attr*='x']``, their combinations, descendants and comma lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from playbill.functions.dates import AsOf, parse_date, parse_time
from playbill.functions.text import TITLE_LIMIT, classify, project_where, squash, truthy
from playbill.functions.urls import abs_url

#: The usual cap on items of a page; callers pass it as ``max_items``.
MAX_ITEMS = 250
SLICE = 10_000
RAW_ITEM = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("source_name", pa.string()), ("pos", pa.int32())]
                     + [(c, pa.string()) for c in ("name", "date_text", "link", "image", "price", "error")])

# Elements without content, and ones a sibling closes.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"},
          "p": set("li td th dd div section article main header footer aside form blockquote ul ol table".split())}

PART = re.compile(r"(\*|[A-Za-z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*(?:'([^']*)'|\"([^\"]*)\"|([\w-]+))\s*)?\]")
COMPARE = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith}


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def descendants(self) -> Iterator[Element]:
        """Elements below this one in document order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Element):
                yield child
                stack.append(iter(child.children))

    def text(self) -> str:
        parts, stack = [], [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                parts.append(child)
            else:
                stack.append(iter(child.children))
        return "".join(parts)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self.close_open(tag)
        child = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def close_open(self, tag):
        """An element whose end was left out ends where a sibling starts, with all that is open inside it."""
        node = self.at
        while node.parent is not None and node.tag not in CLOSES[tag] and node.tag not in WITHIN[tag]:
            node = node.parent
        if node.tag in CLOSES[tag]:
            self.at = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_selector(text: str) -> list[list[list[tuple]]]:
    """Alternatives, each a chain of compounds; ValueError if unsupported."""
    chains = []
    for alternative in text.split(","):
        compounds = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative.strip())
        chain = []
        for compound in compounds:
            tests, end = [], 0
            for m in PART.finditer(compound):
                if m.start() != end or (m[1] and end):
                    raise ValueError(f"unsupported selector: {text}")
                tests.append(tuple(m.groups()))
                end = m.end()
            if end != len(compound):
                raise ValueError(f"unsupported selector: {text}")
            chain.append(tests)
        if not chain:
            raise ValueError(f"unsupported selector: {text}")
        chains.append(chain)
    return chains


def _passes(el: Element, tests: list[tuple]) -> bool:
    for tag, cls, ident, attr, op, *values in tests:
        if tag and tag != "*" and el.tag != tag.lower():
            return False
        if cls and cls not in el.attrs.get("class", "").split():
            return False
        if ident and el.attrs.get("id") != ident:
            return False
        if attr:
            have = el.attrs.get(attr.lower())
            want = next((v for v in values if v is not None), "")
            if have is None or (op and not (want or op == "=") or op and not COMPARE[op](have, want)):
                return False
    return True


def _matches(el: Element, chain: list[list[tuple]]) -> bool:
    if not _passes(el, chain[-1]):
        return False
    node = el.parent
    for tests in reversed(chain[:-1]):
        while node is not None and not _passes(node, tests):
            node = node.parent
        if node is None:
            return False
        node = node.parent
    return True


def select(root: Element, selector: str) -> Iterator[Element]:
    chains = parse_selector(selector)
    return (el for el in root.descendants() if any(_matches(el, c) for c in chains))


FIELDS = ["name", "date", "ticketLink", "image", "price"]


def chains_of(sel: dict) -> dict[str, list]:
    """Parsed field selectors; one that is missing or unsupported finds nothing."""
    out = {}
    for field in FIELDS:
        try:
            out[field] = parse_selector(sel.get(field) or "")
        except ValueError:
            out[field] = []
    return out | {"timed": parse_selector("time[datetime]")}


def first_matches(root: Element, chains: dict[str, list]) -> dict[str, Element]:
    """The first element below ``root`` for each selector, found in one walk that ends when all are."""
    found: dict[str, Element] = {}
    open_fields = {f: c for f, c in chains.items() if c}
    for el in root.descendants():
        for field in [f for f, c in open_fields.items() if any(_matches(el, chain) for chain in c)]:
            found[field] = el
            del open_fields[field]
        if not open_fields:
            break
    return found


def page_items(html: str | None, sel: dict | None) -> Iterator[dict]:
    if html is None:
        raise ValueError("no page text")
    if not sel or not (sel.get("item") or "").strip():
        raise ValueError("selectors.item is not configured")
    chains = chains_of(sel)
    for el in select(Tree(html).root, sel["item"]):
        at = first_matches(el, chains)
        date, link, image, timed = (at.get(f) for f in ("date", "ticketLink", "image", "timed"))
        stamp = (date.attrs.get("datetime", "") if date else "") or (timed.attrs["datetime"] if timed else "")
        yield {
            "name": at["name"].text() if "name" in at else "",
            "date_text": stamp or (date.text() if date else ""),
            "link": link.attrs.get("href", "") if link else "",
            "image": (image.attrs.get("src") or image.attrs.get("data-src", "")) if image else "",
            "price": at["price"].text() if "price" in at else "",
        }


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow in, Arrow out; rows leave in slices so a batch of large pages stays small.

    Whatever goes wrong on a page becomes its error row, so one page never stops the others.
    """
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            page = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            head = {k: page[k] for k in ("page_id", "url", "source_name")}
            try:
                rows += [head | {"pos": n} | item for n, item in enumerate(page_items(page["html"], page["selectors"]))]
            except Exception as e:  # noqa: BLE001  (any fault of a page is that page's)
                rows.append(head | {"error": f"unreadable page: {e}" if isinstance(e, ValueError) else f"unreadable page: {type(e).__name__}"})
            if len(rows) >= SLICE:
                yield pa.RecordBatch.from_pylist(rows, RAW_ITEM)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, RAW_ITEM)


def html_items(pages: DataFrame) -> DataFrame:
    """Raw item fields of pages joined with their registry entry.

    Needs (page_id, url, html, source_name, selectors).
    """
    return pages.select("page_id", "url", "html", "source_name", "selectors").mapInArrow(_extract, from_arrow_schema(RAW_ITEM))


def _judged(items: DataFrame, usable: bool, as_of: AsOf, zone: str, title_limit: int, max_items: int | None) -> DataFrame:
    """Items with parsed title, date and time that are usable, or those that are not."""
    within = F.lit(True) if max_items is None else F.col("pos") < max_items

    def good(r: Column) -> Column:
        return r["within"] & r["error"].isNull() & (r["title"] != "") & r["date"].isNotNull() & (F.char_length(r["title"]) <= title_limit)

    return project_where(items, ["page_id", "url", "pos", "source_name", "link", "image", "price"], {
        "title": F.coalesce(squash("name"), F.lit("")), "date": parse_date("date_text", as_of, zone),
        "time": parse_time("date_text", zone), "error": F.col("error"), "within": F.coalesce(within, F.lit(True)),
    }, good if usable else lambda r: ~good(r))


def rejected_items(items: DataFrame, as_of: AsOf, zone: str = "UTC", title_limit: int = TITLE_LIMIT,
                   max_items: int | None = None) -> DataFrame:
    """(page_id, pos, source_name, reason) of every page error and every item that gives no record; see ``map_items``."""
    rest = _judged(items, False, as_of, zone, title_limit, max_items)
    reason = (F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("within"), "over the cap")
              .when(F.col("title") == "", "no title").when(F.char_length("title") > title_limit, "title too long").otherwise("no date"))
    return rest.select("page_id", "pos", "source_name", reason.alias("reason"))


def item_report(items: DataFrame, as_of: AsOf, zone: str = "UTC", title_limit: int = TITLE_LIMIT,
                max_items: int | None = None) -> DataFrame:
    """(source_name, reason) of every item and page error; reason is null for a record. Feeds ``extraction_health``."""
    usable = _judged(items, True, as_of, zone, title_limit, max_items)
    return usable.select("source_name", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected_items(items, as_of, zone, title_limit, max_items).select("source_name", "reason"))


def map_items(items: DataFrame, registry: DataFrame, as_of: AsOf, zone: str = "UTC", title_limit: int = TITLE_LIMIT,
              max_items: int | None = None) -> DataFrame:
    """Items with a title and a date as raw records.

    ``max_items`` keeps the first items of each page: one with very many usually has a loose selector.
    Longer titles than ``title_limit`` are markup that was not meant. Nothing is lost silently: the
    others are in ``rejected_items``. An item of a source without a registry row takes the source's name
    as its venue, and its links stand relative to the page.
    """
    reg = registry.select("source_name", "name", "venue", "city", "category", F.col("url").alias("site")).select(
        "source_name", F.coalesce(truthy("venue"), "name").alias("venue"), truthy("city").alias("city"),
        "category", "site")
    usable = _judged(items, True, as_of, zone, title_limit, max_items)
    base = F.coalesce("site", "url")
    return usable.join(reg, "source_name", "left").select(
        "page_id", "pos", "source_name", F.lit("scrape").alias("source"), "title",
        F.lit(None).cast("string").alias("artist"), F.coalesce("venue", "source_name").alias("venue"), "city", "date", "time",
        classify("title", F.coalesce(truthy("category"), F.lit("music"))).alias("category"),
        F.coalesce("category", F.lit("")).alias("genre_tags"),
        abs_url(squash("link"), base).alias("ticket_url"), abs_url(squash("image"), base).alias("image_url"),
        truthy(squash("price")).alias("price_range"))

"""HTML extraction.

A small parser turns each page into an array of element records (the only Python step, Arrow in and
out).  Selectors, first-match-wins, text cleaning, prices and specs are Spark expressions over that
array; a page never leaves its row, so extraction needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as X, urls as U
from ..session import written
from . import merge as M

# The default selectors, in the order in which they are tried.
NAVIGATION_SELECTORS = [
    ".header__inline-menu a", ".list-menu a", ".header-menu a", 'nav[role="navigation"] a', ".navigation-list a",
    ".mobile-nav a", ".drawer__menu a", ".collection-nav a", ".category-navigation a", "header nav a",
    ".main-nav a", ".navbar-nav a",
]
CATEGORY_SELECTORS = [
    ".collection-list a", ".collection-grid a", ".collection-item a", ".collections-grid a",
    ".sidebar .collection-list a", ".collection-sidebar a", ".facets a", ".category-nav a", ".subcategory-nav a",
    ".list-menu--inline a", ".collection-card a", ".category-list a", ".subcategory a", "[data-collection] a",
]
COUNT_SELECTORS = [".product-count", ".count", ".item-count", ".results-count", ".book-count", "[data-count]",
                   ".badge", ".number"]
CARD_SELECTORS = [".card-wrapper", ".product-card-wrapper", ".card__content", ".grid__item", ".product-item",
                  ".product-card", ".collection-product-card", ".book-item", ".product", "[data-product]"]
CARD_LINKS = ['a[href*="/products/"]', 'a[href*="/product/"]', ".card__heading a", ".card__content a",
              ".product-title a", ".title a", "h3 a", "h2 a"]
CARD_PRICES = [".price", ".price__regular", ".price__sale", ".money", ".cost", "[data-price]", ".product-price",
               ".card__price"]
TITLE_SELECTORS = ["h1.product-title", "h1", ".product-name", ".book-title", "[data-product-title]"]
PRICE_SELECTORS = [".price", ".product-price", ".cost", "[data-price]", ".price-current"]
IMAGE_SELECTORS = [".product-images img", ".product-gallery img", ".book-images img", ".main-image img",
                   ".product-image img"]
SUMMARY_SELECTORS = [".product-description", ".book-description", ".description", ".summary", "[data-description]"]
SPEC_SELECTORS = [".product-specs", ".specifications", ".book-details", ".product-details", ".details-table"]
SPEC_ITEMS = ["li", ".spec-item", ".detail-item"]
STOCK_SELECTORS = [".availability", ".stock-status", ".in-stock", ".out-of-stock", "[data-availability]"]
NEXT_SELECTORS = [".pagination .next:not(.disabled)", ".pager .next:not(.disabled)", 'a[aria-label="Next"]',
                  ".next-page:not(.disabled)", "[data-next]:not(.disabled)"]

# ---- pages to element records -------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
              "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_NAMED_ATTRIBUTES = ("role", "aria-label")
BATCH_BYTES = 4 << 20


_FIELDS = {"n": "int", "last": "int", "parent": "int", "tag": "string", "marks": "string", "inside": "long",
           "href": "string", "src": "string", "data_src": "string", "start": "int", "size": "int"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType()}
_NODES = T.ArrayType(T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in _FIELDS.items()]))
_UNMARK = str.maketrans("/|", "__")


# ---- selectors, taken apart -----------------------------------------------------------------------

_TOKEN = re.compile(r':not\((?P<no>[^)]+)\)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<val>[^"]*)")?\]'
                    r'|(?P<mark>[.#]?[\w-]+)')


def _marks(compound: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Marks that must be there, marks that must not, and (column, substring) tests of one compound selector."""
    must, must_not, contains = [], [], []
    for token in _TOKEN.finditer(compound):
        if token["no"]:
            must_not.append(token["no"])
        elif token["op"] == "*=":
            contains.append((token["attr"].replace("-", "_"), token["val"]))
        elif token["attr"]:
            must.append(f"[{token['attr']}={token['val']}]" if token["op"] else f"[{token['attr']}]")
        else:
            must.append(token["mark"])
    return must, must_not, contains


def _compounds(selector: str) -> list[str]:
    return re.findall(r'(?:\[[^\]]*\]|[^\s\[])+', selector)


def _chains(selectors: list[str]) -> list[tuple[str, ...]]:
    """The ancestor parts of selectors, each with the parts before it: ("nav",), ("header", "nav"), ...

    An element carries one bit for each of them, so a record has the same size however deep the element lies.
    """
    found = {tuple(_compounds(s)[:k]) for s in selectors for k in range(1, len(_compounds(s)))}
    return sorted(found, key=lambda c: (len(c), c))


# All default selectors; others are named when pages are parsed.
_DEFAULTS = [s for name, value in sorted(globals().items()) if isinstance(value, list) and name.isupper() for s in value]
_CHAINS = _chains(_DEFAULTS)
MAX_CHAINS = 62


def _bit(ancestors: tuple[str, ...], chains: list[tuple[str, ...]]) -> int:
    return 1 << chains.index(ancestors)


def _compiled(chains: list[tuple[str, ...]]) -> dict[str, list[tuple]]:
    """By one mark of a chain's last part: the other marks, those it must not have, the bit before, the bit."""
    found = {}
    for chain in chains:
        must, must_not, _ = _marks(chain[-1])
        found.setdefault(must[0], []).append(
            (set(must), set(must_not), _bit(chain[:-1], chains) if chain[:-1] else 0, _bit(chain, chains)))
    return found


class _Elements(HTMLParser):
    """Collects the elements of a run of pages in document order, one list per field.

    n, last and parent number the elements of one page; marks are an element's tag, classes, id and
    attributes; inside has a bit for each chain of selectors that its ancestors fulfil; start and size
    are its range in the page's text.
    """

    def __init__(self, chains: list[tuple[str, ...]] = _CHAINS) -> None:
        super().__init__(convert_charrefs=True)
        self.columns = {name: [] for name in _FIELDS}
        self.texts, self.offsets, self.errors = [], [0], []
        self.chains = _compiled(chains)

    def read(self, html: str) -> None:
        """Adds a page.  One that the parser can't read has an error and no elements; the others are not touched by it."""
        self.reset()
        self.open, self.below, self.parts, self.length, error = [], [0], [], 0, None
        try:
            self.feed(html)
            self.close()
            while self.open:
                self._close()
        except Exception as problem:  # whatever a page holds, it concerns this page only
            error = f"{type(problem).__name__}: {problem}"
            self.parts = []
            for values in self.columns.values():
                del values[self.offsets[-1]:]
        self.errors.append(error)
        self.texts.append("".join(self.parts))
        self.offsets.append(len(self.columns["n"]))

    def handle_starttag(self, tag, attrs):
        columns, base = self.columns, self.offsets[-1]
        closes = _CLOSED_BY.get(tag)
        while closes and self.open and columns["tag"][self.open[-1]] in closes:
            self._close()
        marks, given = [tag], {}
        for name, value in attrs:
            value = value or ""
            given.setdefault(name, value)
            if name == "class":
                marks += [f".{c}" for c in value.split()]
            elif name == "id":
                marks.append(f"#{value}")
            elif name in _NAMED_ATTRIBUTES:
                marks.append(f"[{name}={value}]")
            elif name.startswith("data-"):
                marks.append(f"[{name}]")
        at, inside = len(columns["n"]), self.below[-1]
        row = (at - base, at - base, self.open[-1] - base if self.open else -1, tag,
               "|" + "|".join([m.translate(_UNMARK) for m in marks]) + "|", inside,
               given.get("href"), given.get("src"), given.get("data-src"), self.length, 0)
        for values, value in zip(columns.values(), row):
            values.append(value)
        if tag not in _VOID:
            below, own = inside, set(marks)
            for mark in own & self.chains.keys():
                for must, must_not, before, bit in self.chains[mark]:
                    if must <= own and not must_not & own and before & inside == before:
                        below |= bit
            self.open.append(at)
            self.below.append(below)
            self.tags[tag] = self.tags.get(tag, 0) + 1

    def reset(self):
        super().reset()
        self.tags = {}  # how many elements of each tag are open

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash does not close an element in HTML

    def handle_endtag(self, tag):
        if self.tags.get(tag):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        self.parts.append(data)
        self.length += len(data)

    def _close(self) -> str:
        at, columns = self.open.pop(), self.columns
        self.below.pop()
        self.tags[columns["tag"][at]] -= 1
        columns["last"][at] = len(columns["n"]) - 1 - self.offsets[-1]
        columns["size"][at] = self.length - columns["start"][at]
        return columns["tag"][at]

    def arrow(self) -> list[pa.Array]:
        fields = [pa.array(values, _ARROW[_FIELDS[name]]) for name, values in self.columns.items()]
        return [pa.array(self.texts, pa.string()), pa.ListArray.from_arrays(
            pa.array(self.offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=list(_FIELDS))),
            pa.array(self.errors, pa.string())]


def _parse_batches(batches: Iterator[pa.RecordBatch], chains: list[tuple[str, ...]] = _CHAINS) -> Iterator[pa.RecordBatch]:
    """Replace html by text, nodes and parse_error; output batches are cut by the bytes read, not by rows."""
    for batch in batches:
        kept = batch.drop_columns(["html"])
        start, seen, pages = 0, 0, _Elements(chains)
        for i, html in enumerate(batch.column("html")):
            source = html.as_py() or ""
            pages.read(source)
            seen += len(source)
            if seen >= BATCH_BYTES or i == batch.num_rows - 1:
                rows = kept.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *pages.arrow()],
                                                 names=[*kept.schema.names, "text", "nodes", "parse_error"])
                start, seen, pages = i + 1, 0, _Elements(chains)


RECENCY = ("_at", "_tie")


def with_recency(pages: DataFrame, order: str | None = None) -> DataFrame:
    """Add what tells the newest of several crawls of a page: fetched_at, where pages have it, else the page_id, and a
    hash of the html.  `newest` chooses by it when the html is gone."""
    at = order or ("fetched_at" if "fetched_at" in pages.columns else "page_id")
    return pages.withColumns({"_at": F.col(at), "_tie": F.xxhash64("html")})


def newest(found: DataFrame, purpose: str, url: str = "url") -> DataFrame:
    """What was found on the newest crawl of each url, written once.

    A page that was crawled again must count once: what follows joins pages by url.  Pages without a url are not known to
    be the same and are all kept.  Facts are narrow, so each crawl is read where it lies and no html is moved.
    """
    rows = written(found.withColumn("_id", F.monotonically_increasing_id()), purpose)
    best = M.winners(rows.where(F.col(url).isNotNull()), url, ["_at"], F.col("_tie"))
    columns = [c for c in found.columns if c not in RECENCY]
    return rows.join(best, "_id").select(columns).unionByName(rows.where(F.col(url).isNull()).select(columns))


def parse_pages(pages: DataFrame, selectors: list[str] = (), handler: Callable | None = None) -> DataFrame:
    """pages(…, url, html) with `html` replaced by `text`, `nodes` and `parse_error`.

    `selectors` names those with ancestors that are used later besides the defaults.  A page that can't be parsed has
    no elements and says why in `parse_error`.  A user's handler may take the parser's place.
    """
    chains = [*_CHAINS, *[c for c in _chains(list(selectors)) if c not in _CHAINS]]
    if len(chains) > MAX_CHAINS:
        raise ValueError(f"at most {MAX_CHAINS} different ancestors of selectors")
    kept = [f for f in pages.schema if f.name != "html"]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("nodes", _NODES),
                           T.StructField("parse_error", T.StringType())])
    parse = handler or partial(_parse_batches, chains=chains)
    return pages.select(*[f.name for f in kept], "html").mapInArrow(lambda batches: parse(batches), schema)


# ---- selectors as data, by site ------------------------------------------------------------------

class _Site:
    """The compiled selectors of a site: for each purpose tests of an element, in the order in which they are tried."""

    def __init__(self, purposes: dict[str, list[str]]) -> None:
        self.chains = _chains([s for selectors in purposes.values() for s in selectors])
        self.compiled = _compiled(self.chains)
        self.tests = {purpose: [self._test(s) for s in selectors] for purpose, selectors in purposes.items()}

    def _test(self, selector: str):
        *ancestors, own = _compounds(selector)
        must, must_not, contains = _marks(own)
        bit = _bit(tuple(ancestors), self.chains) if ancestors else 0
        mark = lambda m: f"|{m.translate(_UNMARK)}|"
        return [mark(m) for m in must], [mark(m) for m in must_not], contains, bit

    def pick(self, purpose: str, columns: dict[str, list], start: int, stop: int) -> list[int]:
        """Numbers of the elements of the first selector that matches any."""
        marks, inside = columns["marks"], columns["inside"]
        for must, must_not, contains, bit in self.tests[purpose]:
            hits = [k - start for k in range(start, stop)
                    if inside[k] & bit == bit and all(m in marks[k] for m in must) and not any(m in marks[k] for m in must_not)
                    and all(part in (columns[c][k] or "") for c, part in contains)]
            if hits:
                return hits
        return []


def _parse_by_site(batches: Iterator[pa.RecordBatch], default: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    compiled: dict[str, _Site] = {}
    kind = pa.map_(pa.string(), pa.list_(pa.int32()))
    for batch in batches:
        kept = batch.drop_columns(["html", "selectors"])
        start, seen, pages, picked = 0, 0, _Elements([]), []
        for i, (html, own) in enumerate(zip(batch.column("html"), batch.column("selectors").to_pylist())):
            name = repr(own)
            if name not in compiled:
                compiled[name] = _Site(default | {purpose: selectors for purpose, selectors in own or () if selectors})
            site, source = compiled[name], html.as_py() or ""
            pages.chains = site.compiled
            pages.read(source)
            picked.append([(purpose, site.pick(purpose, pages.columns, *pages.offsets[-2:])) for purpose in sorted(site.tests)])
            seen += len(source)
            if seen >= BATCH_BYTES or i == batch.num_rows - 1:
                rows = kept.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *pages.arrow(), pa.array(picked, kind)],
                                                 names=[*kept.schema.names, "text", "nodes", "parse_error", "picked"])
                start, seen, pages, picked = i + 1, 0, _Elements([]), []


def parse_by_site(pages: DataFrame, sites: DataFrame, default: dict[str, list[str]]) -> DataFrame:
    """pages(…, url, html) parsed with the selectors of their site: `parse_pages` and `picked`, for each purpose the numbers
    of the elements of the first selector that matches any.

    sites: host and selectors (map of purpose to selectors), one row per host; what a site does not name, and pages of
    unknown hosts, fall back on `default`.  A worker compiles the selectors of a site once.  A site may have up to 62
    different ancestors, however many all sites have together.  The join is by host, and Spark's own size check tells
    whether the sites, not the pages, are what is moved.
    """
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    joined = pages.withColumn("_host", host).join(sites.select(F.lower("host").alias("_host"), "selectors"), "_host", "left").drop("_host")
    kept = [f for f in pages.schema if f.name != "html"]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("nodes", _NODES), T.StructField("parse_error", T.StringType()),
                           T.StructField("picked", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))])
    return joined.select(*[f.name for f in kept], "html", "selectors").mapInArrow(partial(_parse_by_site, default=default), schema)


def picked(purpose: str) -> Column:
    """The elements that a site's selectors pick for a purpose, in document order."""
    return F.transform(F.element_at("picked", F.lit(purpose)), lambda n: F.get(F.col("nodes"), n))


def picked_text(purpose: str) -> Column:
    """Text of the first of them, null without any."""
    return _first(picked(purpose), _text)


# ---- selectors as expressions -------------------------------------------------------------------

def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _test(selector: str, extra: list[str]) -> str:
    """A CSS selector (tags, classes, ids, attributes, :not, descendants) as SQL about an element record x."""
    *ancestors, own = _compounds(selector)
    must, must_not, contains = _marks(own)
    tests = [f"contains(x.marks, {_quoted(f'|{m}|')})" for m in must]
    tests += [f"NOT contains(x.marks, {_quoted(f'|{m}|')})" for m in must_not]
    tests += [f"coalesce(contains(x.{column}, {_quoted(part)}), false)" for column, part in contains]
    if ancestors:
        chains = [*_CHAINS, *[c for c in _chains(extra) if c not in _CHAINS]]
        tests.append(f"x.inside & {_bit(tuple(ancestors), chains)}L != 0")
    return " AND ".join(tests)


def select_all(nodes: str, *selectors: str) -> Column:
    """Elements of an array column that match any of the selectors, in document order.

    Selectors with ancestors other than the defaults' must be those, in all, that the pages were parsed with.
    """
    return F.expr(f"filter({nodes}, x -> {' OR '.join(f'({_test(s, list(selectors))})' for s in selectors)})")


def first_hit(nodes: str, selectors: list[str]) -> Column:
    """All elements of the first selector that matches any.

    Each element is ranked by the first selector it matches; those of the least rank are the hit.
    """
    rank = "CASE " + " ".join(f"WHEN {_test(s, list(selectors))} THEN {i}" for i, s in enumerate(selectors)) + " END"
    return F.expr(f"transform(array(array_min(transform({nodes}, x -> {rank}))), least -> filter({nodes}, x -> {rank} = least))[0]")


def _first(elements: Column, use: Callable[[Column], Column]) -> Column:
    """A function of the first element, null when there is none.  The element is looked up once."""
    return F.get(F.transform(F.slice(elements, 1, 1), use), F.lit(0))


def _inside(elements: Column, node: Column) -> Column:
    """Those elements that are descendants of a node."""
    return F.filter(elements, lambda x: (x["n"] > node["n"]) & (x["n"] <= node["last"]))


def _text(node: Column) -> Column:
    return X.trim_all(F.substr(F.col("text"), node["start"] + 1, node["size"]))


def _resolved(link: Column) -> Column:
    return U.resolve_url(F.col("url"), F.coalesce(link, F.lit("")))


def _image(node: Column) -> Column:
    return F.coalesce(F.nullif(_resolved(node["src"]), F.lit("")), node["data_src"], F.lit(""))


def first_text(nodes: str, selectors: list[str]) -> Column:
    """Text of the first selector whose first element has any."""
    return F.coalesce(*[F.nullif(_first(select_all(nodes, s), _text), F.lit("")) for s in selectors])


# ---- the four page readers -----------------------------------------------------------------------

def menu(selectors: list[str] = NAVIGATION_SELECTORS) -> Column:
    """The menu's links: position, title, source_url."""
    return F.transform(first_hit("nodes", selectors), lambda a: F.struct(
        a["n"].alias("position"), X.clean_text(_text(a)).alias("title"), _resolved(a["href"]).alias("source_url")))


def catalogue_links(found: DataFrame) -> DataFrame:
    """page_id, url and the links in `menu` that lead to the catalogue, one row per link."""
    return found.select("page_id", "url", F.inline("menu")).filter(U.is_navigation_link(F.col("title"), F.col("source_url")))


def navigation_links(parsed: DataFrame, selectors: list[str] = NAVIGATION_SELECTORS) -> DataFrame:
    """page_id, position, title, source_url of the menu links that lead to the catalogue."""
    return catalogue_links(parsed.select("page_id", "url", menu(selectors).alias("menu")))


def with_category_links(parsed: DataFrame, selectors: list[str] = CATEGORY_SELECTORS) -> DataFrame:
    """Add `links`: position, title, source_url, product_count of each category link of the page.

    The text of a link holds that of everything inside it, so a title nested in it needs no extra look.
    """
    # Counters carry the number in their text, so the search below compares only positions.
    counters = F.transform(select_all("nodes", *COUNT_SELECTORS), lambda x: F.struct(
        x["n"].alias("n"), x["marks"].alias("marks"), x["inside"].alias("inside"), x["href"].alias("href"),
        X.first_match(_text(x), r"(\d+)", 1).try_cast("int").alias("number")))

    def count(a: Column) -> Column:
        """First selector whose counter in the link, its parent or its box has a number."""
        spans = F.array(
            F.struct(a["n"].alias("n"), a["last"].alias("last")),
            F.struct(F.get(F.col("nodes"), a["parent"])["n"].alias("n"), F.get(F.col("nodes"), a["parent"])["last"].alias("last")),
            F.try_element_at(F.filter(F.col("_boxes"), lambda b: (b["n"] <= a["n"]) & (b["last"] >= a["n"])), F.lit(-1)))

        def numbers(bound: Column) -> Column:
            tried = []
            for selector in COUNT_SELECTORS:
                near = select_all("_counters", selector)
                found = F.filter(F.transform(bound, lambda b: F.get(_inside(near, b), F.lit(0))), lambda x: x.isNotNull())
                tried.append(F.get(found, F.lit(0))["number"])
            return F.coalesce(*tried, F.lit(0))
        return X.bind(spans, numbers)

    links = F.transform(first_hit("nodes", selectors), lambda a: F.struct(
        a["n"].alias("position"), X.clean_text(_text(a)).alias("title"), _resolved(a["href"]).alias("source_url"),
        count(a).alias("product_count")))
    boxes = F.transform(select_all("nodes", ".category-item"), lambda b: F.struct(b["n"].alias("n"), b["last"].alias("last")))
    return (parsed.withColumns({"_counters": counters, "_boxes": boxes})
            .withColumn("links", F.filter(links, lambda x: (x["title"] != "") & (x["source_url"] != "")
                                          & ~x["source_url"].contains("#")))
            .drop("_counters", "_boxes"))


def category_links(parsed: DataFrame, selectors: list[str] = CATEGORY_SELECTORS) -> DataFrame:
    """page_id, url and the link columns, one row per category link."""
    return with_category_links(parsed, selectors).select("page_id", "url", F.inline("links"))


def with_cards(parsed: DataFrame, selectors: list[str] = CARD_SELECTORS) -> DataFrame:
    """Add `cards`: position, title, product_url, price, currency, thumbnail of each product card of the page."""
    def card(c: Column) -> Column:
        link = _first(_inside(F.col("_links"), c), lambda a: F.struct(
            X.clean_text(_text(a)).alias("title"), _resolved(a["href"]).alias("url")))
        price = _first(_inside(F.col("_prices"), c), lambda p: X.bind(_text(p), lambda t: F.struct(
            X.price_of(t).alias("price"), X.currency_of(t).alias("currency"))))
        return F.struct(c["n"].alias("position"), link.alias("link"), price.alias("price"),
                        F.coalesce(_first(_inside(F.col("_images"), c), _image), F.lit("")).alias("thumbnail"))

    def flat(c: Column) -> Column:
        return F.struct(
            c["position"].alias("position"), c["link"]["title"].alias("title"), c["link"]["url"].alias("product_url"),
            c["price"]["price"].alias("price"), c["price"]["currency"].alias("currency"), c["thumbnail"].alias("thumbnail"))

    found = F.filter(F.transform(first_hit("nodes", selectors), card),
                     lambda c: (c["link"]["title"] != "") & (c["link"]["url"] != ""))
    return (parsed.withColumns({"_links": select_all("nodes", *CARD_LINKS), "_prices": select_all("nodes", *CARD_PRICES),
                                "_images": select_all("nodes", "img")})
            .withColumn("cards", F.transform(found, flat)).drop("_links", "_prices", "_images"))


def listings(parsed: DataFrame, selectors: list[str] = CARD_SELECTORS) -> DataFrame:
    """page_id, url and the card columns, one row per product card."""
    return with_cards(parsed, selectors).select("page_id", "url", F.inline("cards"))


def _specs() -> Column:
    """Specs from the prepared columns: table rows of the box (`_rows`, `_cells`), else its list items (`_items`)."""
    pair = lambda key, value: F.struct(X.spec_key(key).alias("key"), value.alias("value"))

    def table_row(r: Column) -> Column:
        return X.bind(F.transform(F.slice(_inside(F.col("_cells"), r), 1, 2), _text),
                     lambda own: pair(F.get(own, F.lit(0)), F.get(own, F.lit(1))))

    lines = F.filter(F.transform(F.col("_items"), lambda i: _text(i)), lambda t: t.contains(":"))
    entries = F.when(F.size("_rows") > 0, F.transform("_rows", table_row)).otherwise(F.transform(lines, X.spec_pair))
    full = F.filter(entries, lambda e: (F.coalesce(e["key"], F.lit("")) != "")
                    & (F.coalesce(e["value"], F.lit("")) != ""))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.aggregate(full, empty, lambda m, e: X.merge_maps(m, F.create_map(e["key"], e["value"]))), empty)


def product_details(parsed: DataFrame, source_id_pattern: str = r"/product/([^/]+)", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: title, source_url, source_id, price, currency, image_urls, summary, specs, available, and `keep`.

    The element arrays are narrowed in stages, so no array is searched again inside another search.
    """
    nodes, box = "nodes", F.col("_box")
    # The first selector with an element decides, whatever its text.
    stock = F.coalesce(*[_first(select_all(nodes, s), _text) for s in STOCK_SELECTORS])
    staged = parsed.withColumns({
        "_box": F.get(first_hit(nodes, SPEC_SELECTORS), F.lit(0)), "_price": first_text(nodes, PRICE_SELECTORS),
        "_images": F.transform(first_hit(nodes, IMAGE_SELECTORS), _image), "_stock": stock,
    }).withColumns({
        "_rows": _inside(select_all(nodes, "tr"), box), "_cells": _inside(select_all(nodes, "td", "th"), box),
        "_items": _inside(select_all(nodes, *SPEC_ITEMS), box)})
    return staged.select(
        "page_id", X.clean_text(first_text(nodes, TITLE_SELECTORS)).alias("title"), F.col("url").alias("source_url"),
        U.source_id(F.col("url"), source_id_pattern).alias("source_id"), X.price_of(F.col("_price")).alias("price"),
        X.currency_of(F.col("_price")).alias("currency"),
        F.array_distinct(F.filter("_images", lambda u: u != "")).alias("image_urls"),
        X.clean_text(first_text(nodes, SUMMARY_SELECTORS)).alias("summary"), _specs().alias("specs"),
        X.is_available(F.col("_stock")).alias("available"), "parse_error", *keep)


def with_page_facts(parsed: DataFrame) -> DataFrame:
    """Add page_title, has_next and next_url."""
    links = [_first(select_all("nodes", s), lambda x: F.coalesce(x["href"], F.lit(""))) for s in NEXT_SELECTORS]
    return parsed.withColumn("_links", F.array(*links)).withColumns({
        "page_title": X.clean_text(first_text("nodes", ["title"])),
        "has_next": F.exists("_links", lambda h: h.isNotNull()),
        "next_url": F.nullif(_resolved(F.get(F.filter("_links", lambda h: h != ""), F.lit(0))), F.lit("")),
    }).drop("_links")


def page_facts(parsed: DataFrame) -> DataFrame:
    return with_page_facts(parsed).select("page_id", "url", "page_title", "has_next", "next_url")

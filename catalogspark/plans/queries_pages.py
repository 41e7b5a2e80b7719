"""Queries over stored pages, urls and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X, urls as U
from ..operators import extract as E, images as I, merge as M
from ..session import scratch_path, spread
from ..sources import adapters as A
from ..sources.exports import Snapshots
from . import ingest
from .registry import query
from .views_sql import SITE, with_views

# The given pages have plain menus and one heading; the default selectors are for shop themes.
SITE_MENU = ["nav a"]

_LINKS = r"""SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), '<a href="[^"]*">[^<]*</a>'))
  AS link FROM pages"""
_LINK_ROWS = r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(regexp_extract(link, 'href="([^"]*)"', 1), '&amp;', '&') AS source_url,
  trim(regexp_replace(replace(regexp_extract(link, '>([^<]*)<', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM links"""
_UTILITY = "|".join(U.UTILITY_TITLES)


@query("page_links", with_views(
    f"""SELECT page_id, title, source_url FROM rows WHERE title <> '' AND NOT regexp_matches(title, '(?i){_UTILITY}')
    AND NOT contains(source_url, '#')""", links=_LINKS, rows=_LINK_ROWS))
def page_links(spark, sf):
    return E.navigation_links(E.parse_pages(A.page(spark, sf), SITE_MENU), SITE_MENU).select("page_id", "title", "source_url")


def _unescaped(sql: str) -> str:
    """SQL that decodes the entities found in the pages, with or without their semicolon."""
    for entity, character in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&#x27;?", "''"), ("&amp;?", "&")):
        sql = f"regexp_replace({sql}, '{entity}', '{character}', 'g')"
    return sql


def _tag_text(tag: str) -> str:
    text = _unescaped(f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1, 's')")
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


@query("page_titles", f"SELECT page_id, {_tag_text('h1')} AS title, {_tag_text('title')} AS page_title FROM pages")
def page_titles(spark, sf):
    parsed = E.parse_pages(A.page(spark, sf))
    nodes = "nodes"
    return parsed.select("page_id", X.clean_text(E.first_text(nodes, E.TITLE_SELECTORS)).alias("title"),
                         X.clean_text(E.first_text(nodes, ["title"])).alias("page_title"))


@query("page_first_selector", r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'div' ELSE 'nav' END AS tag,
  CAST(CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN len(regexp_extract_all(html, '<div class="ad">'))
    ELSE len(regexp_extract_all(html, '<nav>')) END AS INTEGER) AS hits FROM pages""")
def page_first_selector(spark, sf):
    """A third of the pages has what the first selector wants, a third only what the second does, the others the last."""
    selectors = [".offer section", "div.ad", "nav"]
    hits = E.first_hit("nodes", selectors)
    html, kind = F.col("html"), F.col("page_id") % 3
    mixed = A.page(spark, sf).withColumn("html", F.when(kind == 0, F.concat(
        F.lit('<div class="offer"><section>a</section><p><section>b</section></div>'), html)).when(kind == 2, F.replace(
            html, F.lit('<div class="ad">'), F.lit("<div>"))).otherwise(html))
    return E.parse_pages(mixed, selectors).select("page_id", F.get(hits, F.lit(0))["tag"].alias("tag"), F.size(hits).alias("hits"))


@query("nav_ingest", with_views(
    f"""SELECT source_url, arg_min(title, page_id) AS title FROM rows WHERE title <> ''
    AND NOT regexp_matches(title, '(?i){_UTILITY}') AND NOT contains(source_url, '#') AND page_id = last_page GROUP BY source_url""",
    links=_LINKS, rows=f"SELECT *, max(page_id) OVER (PARTITION BY source_url) AS last_page FROM ({_LINK_ROWS})"))
def nav_ingest(spark, sf):
    """Menu links merged into an empty navigation table."""
    got = ingest.ingest_navigation(A.page(spark, sf), SITE_MENU)
    merged = M.upsert(A.navigation(spark, sf).limit(0), got.rows, "navigation", A.as_of(), ["title"])
    return merged.select("source_url", "title")


_LIST_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE)"


@query("listing_cards", f"""SELECT '{SITE}/products/' || p_partkey AS product_url, p_name AS title,
  CASE WHEN p_partkey % 17 <> 0 THEN {_LIST_PRICE} END AS price, CASE WHEN p_partkey % 17 <> 0 THEN 'GBP' END AS currency,
  '{SITE}/images/' || p_partkey || '.jpg' AS thumbnail FROM part""")
def listing_cards(spark, sf):
    cards = E.listings(E.parse_pages(A.listing_page(spark, sf)))
    return cards.select("product_url", "title", "price", "currency", "thumbnail")


@query("next_pages", f"""SELECT DISTINCT base || CASE WHEN step = 0 THEN '' ELSE '?page=' || (step + 1) END AS url, step < 4 AS has_next,
  CASE WHEN step < 4 THEN base || '?page=' || (step + 2) END AS next_url, 'Brand ' || no AS page_title
  FROM (SELECT substr(p_brand, 7) AS no, (p_partkey // 200) % 5 AS step,
    '{SITE}/collections/brand-' || substr(p_brand, 7) || '-' || (p_partkey // 1000) AS base FROM part)""")
def next_pages(spark, sf):
    facts = E.page_facts(E.parse_pages(A.listing_page(spark, sf)))
    return facts.select("url", "has_next", "next_url", "page_title")


# A chain starts at the first page no other page links to; chains with a missing page start after the gap.
_CHAINS = f"""SELECT no, chain, page_no, page_no - row_number() OVER (PARTITION BY no, chain ORDER BY page_no) AS island, n FROM (
  SELECT substr(p_brand, 7) AS no, p_partkey // 1000 AS chain, p_partkey // 200 AS page_no, count(*) AS n FROM part GROUP BY ALL)"""


@query("category_ingest", with_views(
    f"""SELECT '{SITE}/collections/brand-' || no || '-' || chain || CASE WHEN min(page_no) % 5 = 0 THEN '' ELSE '?page=' || (min(page_no) % 5 + 1) END
      AS source_url, 'Brand ' || no AS title, CAST(sum(n) AS INTEGER) AS product_count FROM chains GROUP BY no, chain, island""",
    chains=_CHAINS))
def category_ingest(spark, sf):
    categories, _, _ = ingest.ingest_category(A.recrawled(A.listing_page(spark, sf)))
    return categories.select("source_url", "title", "product_count")


@query("listing_ingest", f"""SELECT '{SITE}/products/' || p_partkey AS source_url, p_name AS title,
  CASE WHEN p_partkey % 17 <> 0 THEN {_LIST_PRICE} END AS price, true AS has_category,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Summary of ' || p_name END AS summary FROM part""")
def listing_ingest(spark, sf):
    """Listing rows fill what the stored products lack, and take the id of their category."""
    categories, chained, _ = ingest.ingest_category(A.recrawled(A.listing_page(spark, sf)))
    stored = M.upsert(A.category(spark, sf).limit(0), categories, "category", A.as_of(), ["title"]).drop("action")
    rows = ingest.listing_products(chained, stored)
    merged = M.upsert(A.product(spark, sf).withColumn("category_id", F.lit(None).cast("string")), rows, "product", A.as_of(),
                      ["page_url", "position"], mode="fill_only")
    return merged.select("source_url", "title", F.col("price").cast("double").alias("price"),
                         F.col("category_id").isNotNull().alias("has_category"), "summary")


@query("category_links", f"""SELECT '{SITE}/collections/s' || s_suppkey AS source_url, s_name || ' (' || (s_suppkey % 90) || ' books)' AS title,
  CAST(s_suppkey % 90 AS INTEGER) AS product_count FROM supplier""")
def category_links(spark, sf):
    links = E.category_links(E.parse_pages(A.category_list_page(spark, sf)))
    return links.select("source_url", "title", "product_count")


_DETAILS = f"""SELECT p_partkey AS k, '{SITE}/product/' || p_partkey AS source_url, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title,
  CASE WHEN p_partkey % 17 <> 0 THEN {_LIST_PRICE} END AS price,
  CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 5 = 0 THEN 'USD' ELSE 'GBP' END AS currency, 'About ' || p_name AS summary,
  '{SITE}/img/' || p_partkey || '-a.jpg,{SITE}/img/' || p_partkey || '-b.jpg' AS images,
  'cover_type=' || p_type || ';size=' || p_size || CASE WHEN p_partkey % 2 = 1 THEN ':1' ELSE '' END AS specs,
  p_partkey % 10 <> 0 AS available FROM part"""


def _detail_columns(df: DataFrame) -> DataFrame:
    specs = F.transform(F.array_sort(F.map_entries("specs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("source_url", "source_id", "title", F.col("price").cast("double").alias("price"), "currency", "summary",
                     F.array_join("image_urls", ",").alias("images"), F.array_join(specs, ";").alias("specs"), "available")


@query("product_ingest", with_views("SELECT * EXCLUDE (k) FROM details WHERE k % 19 <> 0", details=_DETAILS))
def product_ingest(spark, sf):
    """Detail pages merged into an empty product table; pages without title are refused."""
    got = ingest.ingest_products(A.recrawled(A.detail_page(spark, sf)))
    return _detail_columns(M.upsert(A.product(spark, sf).limit(0), got.rows, "product", A.as_of(), ["title"]))


@query("product_ingest_refused", with_views(
    "SELECT source_url, 'title: required' AS errors FROM details WHERE k % 19 = 0", details=_DETAILS))
def product_ingest_refused(spark, sf):
    refused = ingest.ingest_products(A.recrawled(A.detail_page(spark, sf))).refused
    return refused.select("source_url", F.array_join("errors", "; ").alias("errors"))


@query("product_ingest_strict", """SELECT count(*) AS pages, CAST(0 AS BIGINT) AS merged,
  CASE WHEN count_if(p_partkey % 19 = 0) > 0 THEN 'refused' ELSE 'accepted' END AS verdict FROM part""")
def product_ingest_strict(spark, sf):
    """All-or-nothing over all pages: with untitled pages among them the job fails and nothing is merged."""
    pages = A.detail_page(spark, sf)
    rows = ingest.ingest_products(pages, strict=True).rows
    try:
        merged, verdict = rows.count(), "accepted"
    except Exception as error:
        if "validation failed" not in str(error):
            raise
        merged, verdict = 0, "refused"
    return pages.agg(F.count("*").alias("pages")).select(
        "pages", F.lit(merged).cast("long").alias("merged"), F.lit(verdict).alias("verdict"))


@query("site_selectors", f"""SELECT p_partkey % 3 AS site, p_partkey AS k, CASE WHEN p_partkey % 19 <> 0 THEN p_name END AS title,
  CASE WHEN p_partkey % 17 <> 0 THEN {_LIST_PRICE} END AS price, CAST(CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS images FROM part""")
def site_selectors(spark, sf):
    """Three sites: the default markup; one with its own names for everything; one whose title lies in a box of its own."""
    k = F.col("page_id").cast("bigint")
    renamed = F.replace(F.replace(F.replace(F.col("html"), F.lit('<h1 class="product-title">'), F.lit('<p class="headline big">')), F.lit("</h1>"), F.lit("</p>")),
                        F.lit('class="price"'), F.lit('data-amount="1"'))
    boxed = F.replace(F.replace(F.col("html"), F.lit('<h1 class="product-title">'), F.lit('<h1>Shop</h1><div id="offer"><b>')), F.lit("</h1>"), F.lit("</b></div>"))
    pages = A.detail_page(spark, sf).withColumn("html", F.when(k % 3 == 1, renamed).when(k % 3 == 2, boxed).otherwise(F.col("html")))
    pages = pages.withColumn("url", F.concat(F.element_at(F.array(*[F.lit(f"https://{h}/p/") for h in ("shop.example.com", "Two.example.com", "three.example.com")]),
                                                          (k % 3 + 1).cast("int")), "page_id"))
    sites = spark.createDataFrame([
        ("two.example.com", {"title": ["h1", ".headline:not(.small)"], "price": ["[data-amount]"], "images": ['.product-images img[src*="-a"]']}),
        ("three.example.com", {"title": ["#offer b"], "images": ['img[src*="-a"]']})], "host string, selectors map<string,array<string>>")
    default = {"title": E.TITLE_SELECTORS, "price": E.PRICE_SELECTORS, "images": E.IMAGE_SELECTORS}
    parsed = E.parse_by_site(pages, sites, default)
    return parsed.select((k % 3).alias("site"), k.alias("k"), F.nullif(X.clean_text(E.picked_text("title")), F.lit("")).alias("title"),
                         X.price_of(E.picked_text("price")).cast("double").alias("price"), F.size(E.picked("images")).alias("images"))


# ---- urls -----------------------------------------------------------------------------------------------------

def policy_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Each page url with a path that depends on the page, so that every kind of rule is met."""
    paths = ["/collections/a", "/collections/a?sort_by=price", "/collections/a+b", "/products/x", "/cart/add.js", "/en-gb/admin",
             "/search?q=1", "/cdn/wpm/x.js", "/a.atom", "/x/policies/y", "/account/z", "/i/logo.png"]
    picked = F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("page_id") % len(paths) + 1).cast("int"))
    return A.page(spark, sf).select(
        "page_id", F.when(F.col("page_id") % 29 == 0, F.lit("no url")).otherwise(F.concat(U.origin(F.col("url")), picked)).alias("link"))


_CASES = [("/collections/a", True, True, False, None), ("/collections/a?sort_by=price", False, False, False, 9),
          ("/collections/a+b", False, False, False, 11), ("/products/x", True, False, True, None), ("/cart/add.js", False, False, False, 2),
          ("/en-gb/admin", True, False, False, None), ("/search?q=1", False, False, False, 27), ("/cdn/wpm/x.js", True, False, False, None),
          ("/a.atom", False, False, False, 36), ("/x/policies/y", False, False, False, 23), ("/account/z", False, False, False, 8),
          ("/i/logo.png", True, False, False, None)]


def _case_sql(column: int) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower()
    return "CASE page_id % 12 " + " ".join(f"WHEN {i} THEN {text(case[column])}" for i, case in enumerate(_CASES)) + " END"


@query("url_policy", f"""SELECT page_id, page_id % 29 <> 0 AND {_case_sql(1)} AS allowed, page_id % 29 <> 0 AND {_case_sql(2)} AS collection,
  page_id % 29 <> 0 AND {_case_sql(3)} AS product FROM pages""")
def url_policy(spark, sf):
    link = F.col("link")
    return policy_urls(spark, sf).select("page_id", U.is_url_allowed(link).alias("allowed"), U.is_collection_url(link).alias("collection"),
                                         U.is_product_url(link).alias("product"))


_RULES = " ".join(f"WHEN {n} THEN '{p}'" for n, p in enumerate(U.DISALLOWED_PATTERNS, 1))


@query("url_policy_rule", f"""SELECT rule, CASE rule {_RULES} END AS pattern, count(*) AS urls
  FROM (SELECT CAST(CASE WHEN page_id % 29 = 0 THEN 0 ELSE {_case_sql(4)} END AS INTEGER) AS rule FROM pages) WHERE rule IS NOT NULL GROUP BY rule""")
def url_policy_rule(spark, sf):
    blocked = policy_urls(spark, sf).withColumn("rule", U.blocking_rule(F.col("link"))).filter(F.col("rule").isNotNull())
    return blocked.groupBy("rule").agg(F.count(F.lit(1)).alias("urls")).withColumn(
        "pattern", F.when(F.col("rule") > 0, U.rule_pattern(F.col("rule"))))


@query("url_normalised", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://shop.example.com/p/' || page_id || '?page=2'
  WHEN page_id % 3 = 1 THEN 'https://shop.example.com/a/b' ELSE url END AS link, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/img/1.png' AS image,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/top/x' AS resolved, 'P' || page_id AS source_id FROM pages""")
def url_normalised(spark, sf):
    k, number = F.col("page_id"), F.col("page_id").cast("string")
    raw = (F.when(k % 3 == 0, F.concat(F.lit(f"{SITE}/p/"), number, F.lit("?oseid=9&page=2&preview_theme_id=1")))
           .when(k % 3 == 1, "/a/./c/../b?preview_script_id=5").otherwise(F.col("url")))
    return A.page(spark, sf).select(
        "page_id", U.normalise_url(raw, SITE).alias("link"),
        U.absolute_image_url(F.lit("img/1.png"), F.col("url")).alias("image"),
        U.resolve_url(F.concat(U.origin(F.col("url")), F.lit("/deep/er/page.html")), F.lit("../../top/x")).alias("resolved"),
        U.source_id(F.concat(F.lit(f"{SITE}/product/P"), number, F.lit("/more"))).alias("source_id"))


@query("crawl_delay", """SELECT user_id, CAST(CASE user_id % 5 WHEN 0 THEN 10000 WHEN 1 THEN 10000 WHEN 2 THEN 1000 ELSE 2000 END AS INTEGER) AS delay,
  array_to_string(list_filter([
    CASE WHEN user_id % 3 * 5000 < wanted THEN 'Crawl delay ' || user_id % 3 * 5000 || 'ms is less than recommended ' || wanted
      || 'ms for user agent ' || agent END,
    CASE WHEN user_id % 6 > 3 THEN 'High concurrency (' || user_id % 6 || ') may violate rate limiting policies' END,
    CASE WHEN agent = '' THEN 'User agent should be specified' WHEN user_id % 5 = 3
      THEN 'User agent should identify the scraper clearly and not impersonate a regular browser' END], lambda t: t IS NOT NULL), '; ') AS warnings
  FROM (SELECT DISTINCT user_id, ['AhrefsBot/7', 'MJ12bot', 'Pinterestbot', 'Mozilla/5.0', ''][user_id % 5 + 1] AS agent,
    [10000, 10000, 1000, 2000, 2000][user_id % 5 + 1] AS wanted FROM events)""")
def crawl_delay(spark, sf):
    u = F.col("user_id")
    agents = F.array(*[F.lit(a) for a in ("AhrefsBot/7", "MJ12bot", "Pinterestbot", "Mozilla/5.0", "")])
    agent = F.element_at(agents, (u % 5 + 1).cast("int"))
    return A.table(spark, sf, "events").select("user_id").distinct().select(
        "user_id", U.crawl_delay(agent).alias("delay"), F.array_join(U.crawl_warnings(agent, u % 3 * 5000, u % 6), "; ").alias("warnings"))


@query("price_extract", f"""SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 1.0 ELSE {_LIST_PRICE} END AS price,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'EUR' WHEN p_partkey % 4 = 1 THEN 'USD' ELSE 'GBP' END AS currency FROM part""")
def price_extract(spark, sf):
    k = F.col("p_partkey")
    amount = F.col("p_retailprice").cast("decimal(10,2)").cast("string")
    text = (F.when(k % 17 == 0, F.lit("Free")).when(k % 4 == 0, F.concat(F.lit("only €1,"), amount))
            .when(k % 4 == 1, F.concat(F.lit("was $"), amount, F.lit(" now £1"))).otherwise(F.concat(F.lit("Price: £"), amount)))
    return A.table(spark, sf, "part").select("p_partkey", X.price_of(text).alias("price"), X.currency_of(text).alias("currency"))


# ---- images ------------------------------------------------------------------------------------------------------

@query("image_urls_valid", with_views(
    """SELECT id, array_to_string(list_concat(image_urls, ['https://cdn.example.com/image/' || k]), ',') AS urls FROM product""", "product"))
def image_urls_valid(spark, sf):
    """Scraped records as JSON text with image urls in several fields, some of them unusable."""
    record = F.to_json(F.struct(
        F.concat("image_urls", F.array(F.lit("ftp://x/1.jpg"), F.lit(" "))).alias("images"),
        F.concat(F.lit("https://cdn.example.com/image/"), "id").alias("thumbnail"), F.lit("https://x.example.com/doc.pdf").alias("src"),
        F.lit("https://x.example.com/other.png").alias("unused"))).alias("record")
    found = U.image_urls_in(F.parse_json("record"))
    return A.product(spark, sf).select("id", record).select("id", F.array_join(found, ",").alias("urls"))


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number.cast("bigint")), digits, "0")


def _little(number: Column, size: int) -> Column:
    big = _hex(number, 2 * size)
    return F.concat(*[F.substring(big, 2 * i - 1, 2) for i in range(size, 0, -1)])


def image_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Image files rendered from the parts: headers of four formats, broken and empty ones, and some missing."""
    k, i = F.col("k"), F.col("i")
    w, h = k % 500 + 10, i + 20
    content = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 5 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("08060000"), _hex(k, 8)))
        .when(k % 5 == 1, F.concat(F.lit("474946383961"), _little(w, 2), _little(h, 2), F.lit("000000"), _hex(k, 8)))
        .when(k % 5 == 2, F.concat(F.lit("FFD8FFE000040000FFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03"), _hex(k, 8)))
        .when(k % 5 == 3, F.concat(F.lit("524946460000000057454250565038580A00000000000000"), _little(w - 1, 3), _little(h - 1, 3), _hex(k, 8)))
        .otherwise(F.concat(F.lit("3C68746D6C3E"), _hex(k, 8))))
    parts = A.table(spark, sf, "part").filter("p_partkey % 4 > 0 AND p_partkey % 7 > 0")
    rows = spread(parts, "p_partkey").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(1), (F.col("p_partkey") % 4).cast("int"))).alias("i"))
    blob = F.unhex(content)
    return rows.select(F.concat(F.lit("https://cdn.example.com/img/"), k.cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg")).alias("url"),
                       F.length(blob).cast("bigint").alias("length"), blob.alias("content"))


PUBLIC_URL = "https://images.example.com"

_IMAGES = """SELECT k, i, k % 7 > 0 AND k % 11 > 0 AND k % 5 < 4 AS ok, CASE k % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' ELSE 'webp' END AS format,
    CASE k % 5 WHEN 0 THEN 32 WHEN 1 THEN 17 WHEN 2 THEN 22 ELSE 34 END AS size
  FROM (SELECT p_partkey AS k, unnest(range(1, 1 + p_partkey % 4)) AS i FROM part)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return I.image_results(I.product_images(A.product(spark, sf)), I.inspect(image_blobs(spark, sf), PUBLIC_URL))


@query("image_inventory", with_views(
    """SELECT CAST(k AS VARCHAR) AS product_id, CAST(i - 1 AS INTEGER) AS position, ok AS success, CASE WHEN ok THEN format END AS format,
      CASE WHEN ok THEN CAST(k % 500 + 10 AS INTEGER) END AS width, CASE WHEN ok THEN CAST(i + 20 AS INTEGER) END AS height,
      CASE WHEN k % 7 = 0 THEN 'Failed to download image' WHEN k % 11 = 0 THEN 'Empty image data received' WHEN k % 5 = 4 THEN 'Unsupported format' END
      AS error, ok AS keyed, ok AS published FROM images""", images=_IMAGES))
def image_inventory(spark, sf):
    """The manifest: the object key is the digest of the bytes with the format, the public url is its place."""
    rows = _results(spark, sf)
    key = F.concat(F.lit(r"^products/[0-9a-f]{64}\."), F.coalesce("format", F.lit("-")), F.lit("$"))
    return rows.select(
        "product_id", "position", "success", "format", F.col("dimensions.width").alias("width"),
        F.col("dimensions.height").alias("height"), "error", F.coalesce(F.rlike("object_key", key), F.lit(False)).alias("keyed"),
        F.coalesce(F.col("public_url") == F.concat(F.lit(PUBLIC_URL.rstrip("/") + "/"), "object_key"), F.lit(False)).alias("published"))


@query("image_files", with_views(
    """SELECT CAST(k AS VARCHAR) AS product_id, CAST(i - 1 AS INTEGER) AS position, ok AND size <= 33 AS success, CASE WHEN ok AND size <= 33 THEN format END AS format,
      CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'Failed to download image' WHEN k % 5 = 4 THEN 'Unsupported format'
        WHEN size > 33 THEN 'Image too large: 34 bytes (max: 33)' END AS error FROM images""", images=_IMAGES))
def image_files(spark, sf):
    """The images as files, scanned with a guard of 33 bytes: what is larger is listed and not read, empty files are not there."""
    folder = scratch_path(spark, "image-files")
    names = image_blobs(spark, sf).withColumn("name", F.regexp_extract("url", "[^/]+$", 0))
    I.write_blobs(names, folder).agg(F.sum("length")).collect()
    blobs = I.scan_blobs(spark, folder, 33).withColumn("url", F.concat(F.lit("https://cdn.example.com/img/"), F.regexp_extract("url", "[^/]+$", 0)))
    rows = I.image_results(I.product_images(A.product(spark, sf)), I.inspect(blobs, PUBLIC_URL, 33))
    return rows.select("product_id", "position", "success", "format", "error")


@query("image_stats", with_views(
    """SELECT count(*) AS total_processed, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
      CAST(sum(size) FILTER (ok) AS BIGINT) AS total_size, CAST(round(avg(size) FILTER (ok)) AS BIGINT) AS average_size,
      count(*) FILTER (ok AND format = 'jpeg') AS format_jpeg, count(*) FILTER (ok AND format = 'jpg') AS format_jpg,
      count(*) FILTER (ok AND format = 'png') AS format_png, count(*) FILTER (ok AND format = 'webp') AS format_webp,
      count(*) FILTER (ok AND format = 'gif') AS format_gif FROM images""", images=_IMAGES))
def image_stats(spark, sf):
    return I.image_stats(_results(spark, sf))


@query("image_rejoin", with_views(
    """SELECT CAST(k AS VARCHAR) AS product_id, CAST(count(*) FILTER (ok) AS INTEGER) AS images,
      coalesce(string_agg(format, ',' ORDER BY i) FILTER (ok), '') AS formats, bool_and(ok) AS complete FROM images GROUP BY k""", images=_IMAGES))
def image_rejoin(spark, sf):
    """Per product the public urls of its good images (shown by their formats, in order), and whether all were good."""
    formats = F.transform("image_urls", lambda u: F.regexp_extract(u, r"\.([a-z]+)$", 1))
    return I.rejoin(_results(spark, sf)).select(
        "product_id", F.size("image_urls").alias("images"), F.array_join(formats, ",").alias("formats"), "complete")


# ---- composite write ---------------------------------------------------------------------------------------------------

@query("composite_publish", with_views(
    f"""SELECT 'navigation' AS entity, count(*) AS n, count(*) FILTER (title LIKE 'New %') AS fresh FROM (
        SELECT coalesce(s.title, n.title) AS title FROM navigation n FULL OUTER JOIN (
          SELECT '{SITE}/nav/s' || s_suppkey AS source_url, 'New ' || s_name AS title FROM supplier) s USING (source_url))
    UNION ALL SELECT 'category', count(*), 0 FROM category
    UNION ALL SELECT 'product', count(*) + (SELECT count(*) FROM part WHERE p_partkey % 19 <> 0), 0 FROM product""",
    "navigation", "category", "product"))
def composite_publish(spark, sf):
    """Navigation, categories and products merged in order and published together, with their row counts."""
    root = scratch_path(spark, "store")
    stores = {name: Snapshots(spark, f"{root}/{name}") for name in ("navigation", "category", "product")}
    for name, df in (("navigation", A.navigation), ("category", A.category), ("product", A.product)):
        stores[name].publish(df(spark, sf), 1)
    menu = A.table(spark, sf, "supplier").select(
        F.concat(F.lit(f"{SITE}/nav/s"), F.col("s_suppkey").cast("string")).alias("source_url"), F.concat(F.lit("New "), "s_name").alias("title"))

    def merge_navigation(state):
        return {"navigation": M.upsert(state["navigation"], menu, "navigation", A.as_of(), ["title"]).drop("action")}

    def merge_products(state):
        rows = ingest.ingest_products(A.recrawled(A.detail_page(spark, sf))).rows
        return {"product": M.upsert(state["product"], rows, "product", A.as_of(), ["title"]).drop("action")}

    def recount(state):
        return {"category": M.refresh_product_counts(state["category"], state["product"]).select(*state["category"].columns)}

    commits = Snapshots(spark, f"{root}/commits")
    counted = ingest.publish_all(stores, commits, [merge_navigation, merge_products, recount], 2)
    published = ingest.read_published(stores, commits)
    rows = [published[name].agg(F.lit(name).alias("entity"), F.lit(counted[name]).cast("bigint").alias("n"),
                                F.count_if(F.col("title").startswith("New ")).alias("fresh")) for name in stores]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_RUN = "(SELECT count(*) FROM navigation)"


@query("composite_job_marks", with_views(
    f"""SELECT id, CASE id WHEN 'j5' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN id = 'j13' THEN 'crawler lost' END AS last_error,
      CAST(NULL AS VARCHAR) AS locked_by, {_RUN} AS navigation, CASE id WHEN 'j5' THEN (SELECT count(*) FROM category) END AS category,
      (SELECT count(*) FROM navigation WHERE parent_id IS NULL) AS roots_left FROM scrape_job WHERE id IN ('j5', 'j13')""",
    "navigation", "category", "scrape_job"))
def composite_job_marks(spark, sf):
    """Two composite writes and the marks of their jobs in the same commits: one goes through, one breaks off half-way."""
    root = scratch_path(spark, "store")
    stores = {name: Snapshots(spark, f"{root}/{name}") for name in ("navigation", "category", "job")}
    for name, df in (("navigation", A.navigation), ("category", A.category), ("job", A.scrape_job)):
        stores[name].publish(df(spark, sf), 1)

    def retitle(state):
        return {"navigation": state["navigation"].withColumn("title", F.upper("title"))}

    def touch(state):
        return {"category": state["category"].withColumn("product_count", F.col("product_count") + 1)}

    def empty(state):
        return {"navigation": state["navigation"].withColumn("parent_id", F.lit(None).cast("string"))}

    def lost(state):
        raise RuntimeError("crawler lost")

    commits = Snapshots(spark, f"{root}/commits")
    ingest.publish_all(stores, commits, [retitle, touch], 2, ingest.JobMark("job", "j5", A.as_of()))
    try:
        ingest.publish_all(stores, commits, [empty, lost], 3, ingest.JobMark("job", "j13", A.as_of()))
    except RuntimeError:
        pass
    published = ingest.read_published(stores, commits)
    roots = published["navigation"].filter("parent_id IS NULL").agg(F.count(F.lit(1))).scalar()
    rows = lambda name: F.col("metadata")[f"rows_{name}"].cast("bigint").alias(name)
    return published["job"].filter(F.col("id").isin("j5", "j13")).select(
        "id", "status", "last_error", "locked_by", rows("navigation"), rows("category"), roots.alias("roots_left"))


@query("run_account", """SELECT requested, successful, refused, broken, successful + refused + broken AS crawled,
  round(successful * 1.0 / (successful + refused + broken), 6) AS success_rate FROM (
  SELECT count(*) + count(*) FILTER (p_partkey % 3 = 0) + count(*) FILTER (p_partkey % 7 = 0) AS requested, count(*) FILTER (p_partkey % 19 <> 0) AS successful,
  count(*) FILTER (p_partkey % 19 = 0) AS refused, count(*) FILTER (p_partkey % 7 = 0) AS broken FROM part)""")
def run_account(spark, sf):
    """Requested against successful pages of a run, in which a third came twice and a seventh again, broken."""
    pages = A.detail_page(spark, sf).select("page_id", "url", "html")
    k = F.col("page_id").cast("bigint")
    crawl = (pages.withColumn("fetched_at", F.lit(2)).unionByName(pages.filter(k % 3 == 0).withColumn("fetched_at", F.lit(1)))
             .unionByName(pages.filter(k % 7 == 0).select("page_id", F.concat("url", F.lit("#broken")).alias("url"),
                                                         F.concat(F.lit("<![foo bar]>"), "html").alias("html"), F.lit(2).alias("fetched_at"))))
    return ingest.run_account(crawl, ingest.ingest_products(crawl))


@query("progress_observed", """SELECT count(*) AS written, count(*) AS rows, count(*) FILTER (p_partkey % 10 <> 0) AS available FROM part""")
def progress_observed(spark, sf):
    """Counts taken while the rows are written, beside a count of what was written."""
    df, seen = ingest.observed(A.product(spark, sf), "products", rows=F.count(F.lit(1)), available=F.count_if("available"))
    path = scratch_path(spark, "observed")
    df.write.parquet(path)
    measures = {name: F.lit(value).cast("bigint") for name, value in seen.get.items()}
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")).withColumns(measures)

"""Url joining, crawl policy and image-url rules (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind, first_match, trim_all

# Path patterns a crawler may always fetch, and those it may not.  The first list wins.
ALLOWED_PATTERNS = [
    r"/cdn/",
    r"/tools/sitemap-builder/",
    r"/[a-z]{2}-[a-z]{2}(/|$)",
    r"/.*\.(gif|png|jpe?g|svg|css|pdf)$",
]
DISALLOWED_PATTERNS = [
    r"/admin",
    r"/cart",
    r"/orders",
    r"/checkouts?/",
    r"/checkout$",
    r"/\d{6,}/(checkouts|orders)",
    r"/carts",
    r"/account",
    r"/collections/.*sort_by",
    r"/.*/collections/.*sort_by",
    r"/collections/.*\+",
    r"/collections/.*%2[Bb]",
    r"/.*/collections/.*\+",
    r"/.*/collections/.*%2[Bb]",
    r"/collections/.*filter",
    r"/blogs/.*\+",
    r"/blogs/.*%2[Bb]",
    r"/.*/blogs/.*\+",
    r"/.*/blogs/.*%2[Bb]",
    r"/.*\?.*oseid=",
    r"/.*preview_theme_id",
    r"/.*preview_script_id",
    r"/policies/",
    r"/.*/policies/",
    r"/.*\?.*ls=.*&ls=",
    r"/.*\?.*ls%3[Dd].*%3[Ff]ls%3[Dd]",
    r"/search",
    r"/apple-app-site-association",
    r"/\.well-known/shopify/monorail",
    r"/cdn/wpm/.*\.js",
    r"/recommendations/products",
    r"/.*/recommendations/products",
    r"/cart/(update|add|change|clear)\.js",
    r"/cart\.js",
    r"/wpm@",
    r"/.*\.atom$",
]
# Link titles that lead to utility pages (matched anywhere, any case).
UTILITY_TITLES = [
    "my account", "account", "contact", "about", "help", "support", "login", "sign in", "register", "sign up",
    "basket", "cart", "checkout", "wishlist", "track.*order", "returns", "delivery", "terms", "privacy", "cookies",
    "newsletter", "blog", "news",
]
# Query parameters that only track, crawl delays in ms, image file endings and image fields.
TRACKING_PARAMETERS = ["oseid", "preview_theme_id", "preview_script_id"]
CRAWL_DELAYS = [("ahrefs", 10000), ("mj12bot", 10000), ("pinterest", 1000)]
DEFAULT_CRAWL_DELAY = 2000
MAX_CONCURRENCY = 3
BROWSER_AGENTS = "mozilla|chrome|safari"
IMAGE_ENDING = r"(?i)\.(jpg|jpeg|png|gif|webp)(\?.*)?$"
IMAGE_FIELDS = ["image_urls", "imageUrls", "images", "image", "src", "thumbnail", "photo", "picture"]

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def origin(url: Column) -> Column:
    return F.lower(_part(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"))


def path_of(url: Column) -> Column:
    found = _part(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)")
    return F.when(found == "", "/").otherwise(found)


def query_of(url: Column) -> Column:
    """Query with its question mark, '' when there is none."""
    query = _part(url, r"^[^?#]*(\?[^#]*)")
    return F.when(query == "?", "").otherwise(query)


def fragment_of(url: Column) -> Column:
    return _part(url, r"(#.*)$")


def is_parsable(url: Column) -> Column:
    """An absolute url: http(s) needs a host without blanks, other schemes only the scheme."""
    return F.coalesce(F.when(url.rlike(r"(?i)^https?:"), url.rlike(r"(?i)^https?://[^/?#\s]+"))
                      .otherwise(url.rlike(_SCHEME)), F.lit(False))


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    def resolved(p: Column) -> Column:
        segments = F.split(p, "/")
        kept = F.aggregate(
            F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(s == ".", done).otherwise(F.concat(done, F.array(s))))
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
        whole = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//$", "/")
        return F.when(p.contains("/."), whole).otherwise(p)
    return bind(path, resolved)


def resolve_url(base: Column, relative: Column) -> Column:
    """Join a link to the page it stands on.  '' stays '', anything starting with http stays as it is."""
    def joined(p: Column) -> Column:
        page, rel, path = p["page"], p["rel"], p["path"]
        home = origin(page)
        return (
            F.when(rel.rlike(_SCHEME), rel)
            .when(rel.startswith("//"), F.concat(_part(page, r"^([^/]*)"), rel))
            .when(rel.startswith("?"), F.concat(home, path_of(page), rel))
            .when(rel.startswith("#"), F.concat(home, path_of(page), query_of(page), rel))
            .otherwise(F.concat(home, _without_dots(F.concat(
                F.when(rel.startswith("/"), "").otherwise(F.regexp_replace(path_of(page), r"[^/]*$", "")), path)),
                F.regexp_replace(rel, r"^[^?#]*", ""))))

    rel = F.replace(trim_all(relative), F.lit(" "), F.lit("%20"))
    parts = F.struct(base.alias("page"), rel.alias("rel"), _part(rel, r"^([^?#]*)").alias("path"))
    return (F.when(relative.isNull() | (relative == ""), "").when(relative.startswith("http"), relative)
            .when(~is_parsable(base), relative).otherwise(bind(parts, joined)))


def absolute_image_url(image: Column, base: Column) -> Column:
    """http(s) as it is, '//' gets https, the rest hangs on the origin of the page."""
    return (F.when(image.rlike("^https?://"), image)
            .when(image.startswith("//"), F.concat(F.lit("https:"), image))
            .when(~is_parsable(base), image)
            .otherwise(resolve_url(F.concat(origin(base), F.lit("/")), image)))


def normalise_url(url: Column, base: str) -> Column:
    """Absolute url without the tracking parameters; other parameters keep their order and text."""
    def cleaned(full: Column) -> Column:
        kept = F.array_join(F.filter(F.split(F.substr(query_of(full), F.lit(2)), "&"),
                                     lambda p: (p != "") & ~F.split(p, "=")[0].isin(TRACKING_PARAMETERS)), "&")
        query = bind(kept, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise(""))
        return F.when(is_parsable(full), F.concat(origin(full), _without_dots(path_of(full)), query, fragment_of(full)))
    return F.coalesce(bind(F.when(is_parsable(url), url).otherwise(resolve_url(F.lit(base), url)), cleaned), url)


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _policy_path(url: Column) -> Column:
    return F.concat(_without_dots(path_of(url)), query_of(url))


def is_url_allowed(url: Column) -> Column:
    verdict = bind(_policy_path(url), lambda path: path.rlike(_any_of(ALLOWED_PATTERNS))
                   | ~path.rlike(_any_of(DISALLOWED_PATTERNS)))
    return is_parsable(url) & F.coalesce(verdict, F.lit(False))


def blocking_rule(url: Column) -> Column:
    """Number (from 1) of the first rule that forbids a url; null when it may be fetched.

    The rules are a short fixed list, so this is a chain of tests in the scan stage, not a join.
    """
    def first(path: Column) -> Column:
        found = F.when(path.rlike(_any_of(ALLOWED_PATTERNS)), F.lit(None).cast("int"))
        for number, pattern in enumerate(DISALLOWED_PATTERNS, 1):
            found = found.when(path.rlike(pattern), F.lit(number))
        return found
    return F.when(~is_parsable(url), F.lit(0)).otherwise(bind(_policy_path(url), first))


def rule_pattern(number: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in DISALLOWED_PATTERNS]), number - 1)


def is_collection_url(url: Column) -> Column:
    path, query = path_of(url), query_of(url)
    return (is_url_allowed(url) & path.contains("/collections/") & ~query.rlike("sort_by|filter")
            & ~path.rlike(r"\+|%2[Bb]"))


def is_product_url(url: Column) -> Column:
    return is_url_allowed(url) & path_of(url).contains("/products/")


def is_navigation_link(title: Column, url: Column) -> Column:
    return ((title != "") & (url != "") & ~title.rlike(f"(?i){_any_of(UTILITY_TITLES)}")
            & ~url.contains("#") & ~url.contains("javascript:"))


def source_id(url: Column, pattern: str = r"/product/([^/]+)") -> Column:
    return first_match(url, pattern, 1)


def crawl_delay(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    delay = F.lit(DEFAULT_CRAWL_DELAY)
    for word, ms in reversed(CRAWL_DELAYS):
        delay = F.when(low.contains(word), F.lit(ms)).otherwise(delay)
    return delay


def crawl_warnings(agent: Column, delay: Column, concurrency: Column) -> Column:
    wanted = crawl_delay(agent)
    named = F.coalesce(agent, F.lit("")) != ""
    return F.array_compact(F.array(
        F.when(delay < wanted, F.format_string(
            "Crawl delay %dms is less than recommended %dms for user agent %s", delay, wanted, agent)),
        F.when(concurrency > MAX_CONCURRENCY, F.format_string(
            "High concurrency (%d) may violate rate limiting policies", concurrency)),
        F.when(~named, "User agent should be specified").when(
            F.lower(agent).rlike(BROWSER_AGENTS),
            "User agent should identify the scraper clearly and not impersonate a regular browser")))


def valid_image_urls(urls: Column) -> Column:
    """Trimmed http(s) urls that end like an image or mention one."""
    trimmed = F.transform(urls, trim_all)
    return F.filter(trimmed, lambda u: u.rlike("^https?://") & (u.rlike(IMAGE_ENDING) | u.contains("image")))


def image_urls_in(record: Column) -> Column:
    """Image urls of a VARIANT record, from each known field, whether text or list."""
    found = []
    for name in IMAGE_FIELDS:
        many = F.try_variant_get(record, f"$.{name}", "array<string>")
        one = F.when(F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")) == "STRING",
                     F.array(F.try_variant_get(record, f"$.{name}", "string")))
        found.append(F.coalesce(many, one, F.array().cast("array<string>")))
    return valid_image_urls(F.flatten(F.array(*found)))

"""Cache keys, time-to-live rules and freshness classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind, first_match

# Seconds to live by endpoint (tested in this order) and by setting name.
ENDPOINT_TTLS = [("/navigation", 3600), ("/categories", 1800), ("/products/", 120), ("/products", 300)]
DEFAULT_TTL = 60
SETTING_TTLS = {"navigation": 3600, "categories": 1800, "products": 300, "product_detail": 120}
KEY_HOST = "https://cache.example.com/"
# Characters url_encode escapes and a browser leaves alone.
UNESCAPED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
STALE_FACTOR = 3


def _browser_encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    for escaped, plain in UNESCAPED.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return encoded


def cache_key(prefix: Column, parameters: Column, host: str = KEY_HOST) -> Column:
    """host + prefix[:k=v&...]; keys sorted, null values dropped, values escaped."""
    entries = F.array_sort(F.map_entries(F.map_filter(parameters, lambda k, v: v.isNotNull())))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), _browser_encode(e["value"]))), "&")
    return F.concat(F.lit(host), prefix, F.when(F.coalesce(text, F.lit("")) == "", "")
                    .otherwise(F.concat(F.lit(":"), text)))


def endpoint_ttl(endpoint: Column) -> Column:
    ttl = F.lit(DEFAULT_TTL)
    for part, seconds in reversed(ENDPOINT_TTLS):
        ttl = F.when(endpoint.contains(part), F.lit(seconds)).otherwise(ttl)
    return ttl


def ttl_setting(text: Column, default: int) -> Column:
    """Leading integer of a setting, else the default."""
    return F.coalesce(first_match(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def key_prefix(key: Column) -> Column:
    path = F.regexp_extract(key, r"^[a-z]+://[^/]+/([^?#]*)", 1)
    return F.split(path, ":")[0]


def refresh_job(key: Column, site: str) -> Column:
    """The crawl job that refreshes a cache key: struct(type, target_url, metadata), null if none does."""
    pieces = F.split(F.regexp_extract(key, r"^[a-z]+://[^/]+/([^?#]*)", 1), ":")
    given = F.str_to_map(F.coalesce(F.get(pieces, F.lit(1)), F.lit("")), F.lit("&"), F.lit("="))
    names = ("navId", "parentId", "categoryId", "id")
    parsed = bind(F.struct(F.get(pieces, F.lit(0)).alias("prefix"), given.alias("given")), lambda p: F.struct(
        p["prefix"].alias("prefix"),
        *[F.try_url_decode(F.nullif(F.element_at(p["given"], F.lit(n)), F.lit(""))).alias(n) for n in names]))

    def job(p: Column) -> Column:
        prefix, nav, parent, cat, item = p["prefix"], *[p[n] for n in names]
        made = lambda kind, url, *meta: F.struct(
            F.lit(kind).alias("type"), url.alias("target_url"),
            F.map_filter(F.create_map(F.lit("cache_prefix"), prefix, *meta), lambda k, v: v.isNotNull()).alias("metadata"))
        return (F.when(prefix == "navigation", made("navigation", F.lit(site)))
                .when(prefix == "categories", made(
                    "category", F.coalesce(F.concat(F.lit(f"{site}/category/"), nav), F.lit(f"{site}/categories")),
                    F.lit("nav_id"), nav, F.lit("parent_id"), parent))
                .when(prefix == "products", made(
                    "product", F.coalesce(F.concat(F.lit(f"{site}/category/"), cat, F.lit("/products")),
                                          F.lit(f"{site}/products")), F.lit("category_id"), cat))
                .when((prefix == "product_detail") & item.isNotNull(), made(
                    "product", F.concat(F.lit(f"{site}/product/"), item), F.lit("product_id"), item)))
    return bind(parsed, job)


def freshness(age_ms: Column, ttl_s: Column, stale_factor: int = STALE_FACTOR) -> Column:
    return (F.when(age_ms <= ttl_s * 1000, "fresh").when(age_ms <= ttl_s * 1000 * stale_factor, "stale")
            .otherwise("expired"))

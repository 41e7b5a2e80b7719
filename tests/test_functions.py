"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import classify as C, keys as K, text as X, urls as U


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_clean_text(spark):
    got = values(spark, X.clean_text(F.col("t")), [("  Hello   World  \n\t  ",), (None,), (" a  b﻿",)], "t string")
    assert got == ["Hello World", "", "a b"]


@pytest.mark.parametrize("text,price,currency", [
    ("£12.99", 12.99, "GBP"), ("Price: £25.50", 25.5, "GBP"), ("£5", 5.0, "GBP"), ("$15.99", 15.99, "USD"),
    ("€20.50", 20.5, "EUR"), ("Free", None, None), ("£1,234.50", 1.0, "GBP"), ("£12. now", 12.0, "GBP")])
def test_price(spark, text, price, currency):
    assert one(spark, X.price_of(F.lit(text)), X.currency_of(F.lit(text))) == (price, currency)


def test_price_thousands(spark):
    assert one(spark, X.price_of(F.lit("£1,234.50"), thousands=True)) == 1234.5


@pytest.mark.parametrize("base,rel,want", [
    ("https://shop.example.com", "/category/books", "https://shop.example.com/category/books"),
    ("https://shop.example.com", "product/123", "https://shop.example.com/product/123"),
    ("https://shop.example.com", "https://other.com/page", "https://other.com/page"),
    ("https://shop.example.com", "", ""),
    ("https://h.com/a/b/c?x=1", "../d", "https://h.com/a/d"),
    ("https://h.com/a/b/c?x=1", "./e?y=2#z", "https://h.com/a/b/e?y=2#z"),
    ("https://h.com/a/b/c?x=1", "?y=2", "https://h.com/a/b/c?y=2"),
    ("https://h.com/a/b/c?x=1", "#top", "https://h.com/a/b/c?x=1#top"),
    ("https://h.com/a/b/", "//cdn.com/x.png", "https://cdn.com/x.png"),
    ("https://h.com/a", "/x/../../y/", "https://h.com/y/"),
    ("https://h.com/a/b", "..", "https://h.com/"),
    ("https://h.com/a", "mailto:me@h.com", "mailto:me@h.com"),
    ("https://h.com/a", "javascript:void(0)", "javascript:void(0)"),
    ("https://h.com/a", "two words", "https://h.com/two%20words")])
def test_resolve_url(spark, base, rel, want):
    assert one(spark, U.resolve_url(F.lit(base), F.lit(rel))) == want


@pytest.mark.parametrize("url,want", [
    ("https://www.shop.com/collections/fiction", True), ("https://www.shop.com/products/book-1", True),
    ("https://www.shop.com/admin", False), ("https://www.shop.com/cart", False),
    ("https://www.shop.com/checkout", False), ("https://www.shop.com/account", False),
    ("https://www.shop.com/collections/fiction?sort_by=price", False),
    ("https://www.shop.com/collections/fiction+crime", False),
    ("https://www.shop.com/collections/fiction?filter=x", False), ("https://www.shop.com/cart/add.js", False),
    ("https://www.shop.com/a/style.css", True), ("https://www.shop.com/a/logo.png", True),
    ("https://www.shop.com/cdn/x", True), ("https://www.shop.com/en-gb/admin", True),
    ("https://www.shop.com/cartography", False), ("not a url", False), ("/relative", False)])
def test_url_policy(spark, url, want):
    assert one(spark, U.is_url_allowed(F.lit(url))) is want
    rule = one(spark, U.blocking_rule(F.lit(url)))
    assert (rule is None) is want


def test_page_kinds(spark):
    url = lambda u: one(spark, U.is_collection_url(F.lit(u)), U.is_product_url(F.lit(u)))
    assert url("https://s.com/collections/a") == (True, False)
    assert url("https://s.com/collections/a?sort_by=x") == (False, False)
    assert url("https://s.com/products/a") == (False, True)


def test_normalise_url(spark):
    norm = lambda u: one(spark, U.normalise_url(F.lit(u), "https://shop.example.com"))
    assert norm("https://shop.example.com/collections/f?oseid=123&page=2&preview_theme_id=4") == \
        "https://shop.example.com/collections/f?page=2"
    assert norm("/collections/f") == "https://shop.example.com/collections/f"
    assert norm("https://SHOP.example.com") == "https://shop.example.com/"
    assert norm("https://shop.example.com/a?oseid=1") == "https://shop.example.com/a"


def test_crawl_delay(spark):
    got = values(spark, U.crawl_delay(F.col("a")), [("AhrefsBot",), ("MJ12bot",), ("Pinterest",), ("MyBot",), (None,)], "a string")
    assert got == [10000, 10000, 1000, 2000, 2000]


def test_crawl_warnings(spark):
    rows = [("MyBot", 2000, 3), ("Mozilla/5.0", 100, 9), ("", 5000, 1)]
    got = values(spark, F.size(U.crawl_warnings(F.col("a"), F.col("d"), F.col("c"))), rows, "a string, d int, c int")
    assert got == [0, 3, 1]


def test_image_urls(spark):
    urls = ["https://e.com/1.jpg", "https://e.com/2.png", "", "not-a-url", "https://e.com/3.webp", "ftp://e.com/4.jpg",
            "https://e.com/image/5", " https://e.com/6.gif ", "https://e.com/doc.pdf", "https://e.com/7.jpeg?w=1", None,
            "http://e.com/page"]
    got = values(spark, U.valid_image_urls(F.col("u")), [(urls,)], "u array<string>")[0]
    assert got == ["https://e.com/1.jpg", "https://e.com/2.png", "https://e.com/3.webp", "https://e.com/image/5",
                   "https://e.com/6.gif", "https://e.com/7.jpeg?w=1"]


def test_image_urls_in_record(spark):
    record = '{"images": ["https://e.com/1.jpg", "x"], "thumbnail": "https://e.com/2.png", "other": "https://e.com/3.png", "src": 5}'
    assert one(spark, U.image_urls_in(F.parse_json(F.lit(record)))) == ["https://e.com/1.jpg", "https://e.com/2.png"]


def test_absolute_image_url(spark):
    f = lambda i: one(spark, U.absolute_image_url(F.lit(i), F.lit("https://e.com/a/b")))
    assert [f("https://x.com/1.jpg"), f("//x.com/1.jpg"), f("/1.jpg"), f("1.jpg")] == [
        "https://x.com/1.jpg", "https://x.com/1.jpg", "https://e.com/1.jpg", "https://e.com/1.jpg"]


def test_cache_key(spark):
    key = lambda *kv: one(spark, K.cache_key(F.lit("test"), F.create_map(*[F.lit(x) for x in kv]), host=""))
    assert key("b", "2", "a", "1") == key("a", "1", "b", "2") == "test:a=1&b=2"
    assert key("a", "x y&(z)~") == "test:a=x%20y%26(z)~"
    assert one(spark, K.cache_key(F.lit("test"), F.create_map(F.lit("a"), F.lit(None).cast("string")), host="")) == "test"


def test_ttl(spark):
    got = values(spark, K.endpoint_ttl(F.col("e")), [("/api/navigation",), ("/api/categories",), ("/api/products/1",),
                                                     ("/api/products",), ("/x",)], "e string")
    assert got == [3600, 1800, 120, 300, 60]
    assert values(spark, K.ttl_setting(F.col("e"), 300), [("120",), ("12s",), ("x",), (None,)], "e string") == [120, 12, 300, 300]


def test_refresh_job(spark):
    f = lambda k: one(spark, K.refresh_job(F.lit(K.KEY_HOST + k), "https://s.com"))
    assert f("navigation").target_url == "https://s.com"
    assert f("categories:navId=7").target_url == "https://s.com/category/7"
    assert f("products:categoryId=9&limit=20").target_url == "https://s.com/category/9/products"
    assert f("product_detail:id=3").metadata == {"cache_prefix": "product_detail", "product_id": "3"}
    assert f("product_detail") is None and f("other:id=1") is None


def test_freshness(spark):
    got = values(spark, K.freshness(F.col("a") * 1000, F.lit(300)), [(300,), (400,), (900,), (1000,)], "a int")
    assert got == ["fresh", "stale", "stale", "expired"]


def test_labels(spark):
    assert one(spark, X.format_price(F.lit(1234.5), F.lit("GBP"))) == "£1,234.50"
    assert one(spark, X.format_price(F.lit(None).cast("double"), F.lit("GBP"))) == "Price not available"
    assert one(spark, X.truncate(F.lit("hello world"), 6)) == "hello..."
    assert one(spark, X.truncate(F.lit("hello"), 6)) == "hello"
    got = values(spark, X.spec_label(F.col("k")), [("isbn",), ("publication_date",), ("api_url",), ("hand-made",)], "k string")
    assert got == ["ISBN", "Publication Date", "API URL", "Hand-Made"]
    assert values(spark, X.count_label(F.col("n")), [(1,), (1234,)], "n int") == ["1 product", "1,234 products"]
    assert one(spark, X.sanitize(F.lit(" <b>x</b> "))) == "bx/b"


def test_relative_time(spark):
    now = "2024-01-31 12:00:00"
    rows = [("2024-01-31 11:59:30",), ("2024-01-31 11:59:00",), ("2024-01-31 10:00:00",), ("2024-01-30 11:00:00",),
            ("2024-01-05 00:00:00",)]
    got = values(spark, X.relative_time(F.col("t").cast("timestamp"), F.lit(now).cast("timestamp")), rows, "t string")
    assert got == ["Just now", "1 minute ago", "2 hours ago", "1 day ago", "05/01/2024"]


def test_classes(spark):
    urls = [("a/x.js",), ("x.css",), ("x.png",), ("x.png?1",), ("/api/x",)]
    assert values(spark, C.resource_type(F.col("u")), urls, "u string") == ["script", "stylesheet", "image", "other", "api"]
    msgs = [("Network down",), ("Target closed",), ("bad",)]
    assert values(spark, C.is_retryable(F.col("m")), msgs, "m string") == [True, True, False]
    assert values(spark, C.error_kind(F.col("m")), msgs, "m string") == ["other", "crash", "other"]
    assert one(spark, C.is_mobile(F.lit("iPhone"), F.lit(1200)), C.is_mobile(F.lit("X"), F.lit(300)), C.is_mobile(F.lit("X"), F.lit(900))) == (True, True, False)


def test_webhook_payload(spark):
    import json
    text = one(spark, C.webhook_payload(F.lit("error"), F.lit("T"), F.lit("m"), F.lit("s"), F.lit("now"),
                                        F.create_map(F.lit("k"), F.lit("v"))))
    payload = json.loads(text)
    assert payload["text"] == "🚨 ERROR: T"
    assert payload["attachments"][0]["color"] == "#ff6600"
    assert [f["title"] for f in payload["attachments"][0]["fields"]] == ["Message", "Source", "Timestamp", "k"]


def test_specs_functions(spark):
    assert one(spark, X.spec_key(F.lit("Publication Date"))) == "publication_date"
    assert tuple(one(spark, X.spec_pair(F.lit("Ratio: 1:2")))) == ("ratio", "1:2")
    assert values(spark, X.item_count(F.col("t")), [("150 books",), ("(12)",), ("none",)], "t string") == [150, 12, 0]
    assert values(spark, X.is_available(F.col("t")), [("In stock",), ("Out of Stock",), (None,)], "t string") == [True, False, True]
    merged = one(spark, X.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")),
                                     F.create_map(F.lit("b"), F.lit("3"))))
    assert merged == {"a": "1", "b": "3"}

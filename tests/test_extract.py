"""Selectors and page readers on whole pages of an invented garden shop."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogspark.operators import extract as E
from catalogspark.plans import ingest as I

BASE = "https://garden.example.com"
PAGES = "page_id bigint, url string, html string"


def parsed(spark, *pages, selectors=()):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return E.parse_pages(spark.createDataFrame(rows, PAGES), selectors)


def details(title, price="£4.20", stock="In Stock", extra=""):
    return (f'<title>Potting shed</title><h1 class="product-title">{title}</h1><p class="price">{price}</p>{extra}'
            f'<p class="stock-status">{stock}</p>')


def test_menu_links_lead_to_the_catalogue(spark):
    html = ('<header><nav><a href="/spades">Spades</a><a href="/seeds">  Seeds &amp;\n bulbs </a><a href="/account">My Account</a>'
            '<a href="#menu">Open</a><a href="/c">Contact Us</a></nav></header><nav><a href="/footer">Footer</a></nav>')
    got = E.navigation_links(parsed(spark, (BASE, html))).orderBy("position").collect()
    assert [(r.title, r.source_url) for r in got] == [("Spades", f"{BASE}/spades"), ("Seeds & bulbs", f"{BASE}/seeds")]


def test_first_selector_wins_and_others_can_be_named(spark):
    html = ('<div class="main-nav"><a href="/b">Barrows</a></div><ul class="list-menu"><li><a href="/a">Axes</a></ul>'
            '<section class="shed"><div><ol><li><a href="/z">Zinc tubs</a></ol></div></section>')
    assert [r.title for r in E.navigation_links(parsed(spark, (BASE, html))).collect()] == ["Axes"]
    own = [".nothing a", ".shed ol a"]
    assert [r.title for r in E.navigation_links(parsed(spark, (BASE, html), selectors=own), own).collect()] == ["Zinc tubs"]


def test_ancestors_must_stand_in_order(spark):
    html = ('<nav><header><a href="/1">inner header</a></header></nav>'
            '<header><div><nav><p><a href="/2">right</a></p></nav></div></header><header></header><nav><a href="/3">beside</a></nav>')
    hits = parsed(spark, (BASE, html)).select(F.transform(E.select_all("nodes", "header nav a"), lambda x: x["href"]).alias("h"))
    assert hits.first().h == ["/2"]


def test_category_counts_from_link_parent_or_box(spark):
    html = ('<div class="category-list"><p><a href="/rakes">Rakes <b class="badge">12 kinds</b></a></p>'
            '<div class="category-item"><p><a href="/hoes">Hoes</a></p><i class="count">(7)</i></div>'
            '<p><a href="/twine">Twine</a><a href="#x">Top</a></p></div>')
    got = E.category_links(parsed(spark, (BASE, html))).orderBy("position").collect()
    assert [(r.title, r.source_url, r.product_count) for r in got] == [
        ("Rakes 12 kinds", f"{BASE}/rakes", 12), ("Hoes", f"{BASE}/hoes", 7), ("Twine", f"{BASE}/twine", 0)]


def test_cards_without_title_or_link_are_left_out(spark):
    html = ('<div class="product-card"><h3><a href="/p/fork">Fork</a></h3><img src="/f.png"><s class="price">€8,50</s></div>'
            '<div class="product-card"><h3><a href="/p/pot">Pot</a></h3><img data-src="/pot.png"><s class="price">on request</s></div>'
            '<div class="product-card"><s class="price">£1</s></div>')
    got = E.listings(parsed(spark, (BASE, html))).orderBy("position").collect()
    assert [(r.title, r.product_url, r.thumbnail) for r in got] == [
        ("Fork", f"{BASE}/p/fork", f"{BASE}/f.png"), ("Pot", f"{BASE}/p/pot", "/pot.png")]
    assert got[0].currency == "EUR" and got[1].price is None
    assert E.listings(parsed(spark, (BASE, "<p>nothing</p>"))).count() == 0


def test_details(spark):
    table = ('<div class="product-specs"><table><tr><td>Handle</td><td>Ash</td><td>ignored</td><tr><td>Weight</td>'
             '<tr><td>Handle</td><td>Beech</td></table></div>')
    lines = '<ul class="specifications"><li>Length: 90:95 cm<li>no pair<li class="spec-item">Tines: 4</ul>'
    images = '<div class="main-image"><img src="/1.png"><img src="/2.png"/><img src="/1.png"></div>'
    got = {r.page_id: r for r in E.product_details(parsed(
        spark, (f"{BASE}/product/spade-9/x", details("Border\n  spade &lt;S&gt;", extra=images + table + '<div class="summary"> Light. </div>')),
        (f"{BASE}/other", details("Fork", "£99.99", "Out of Stock", lines)), (f"{BASE}/none", ""), (f"{BASE}/null", None))).collect()}
    spade = got[0]
    assert (spade.title, spade.source_id, spade.summary) == ("Border spade <S>", "spade-9", "Light.")
    assert (spade.price, spade.currency, spade.available) == (4.2, "GBP", True)
    assert spade.image_urls == [f"{BASE}/1.png", f"{BASE}/2.png"] and spade.specs == {"handle": "Beech"}
    assert (got[1].available, got[1].source_id, got[1].specs) == (False, None, {"length": "90:95 cm", "tines": "4"})
    assert all((got[k].title, got[k].specs, got[k].image_urls) == ("", {}, []) for k in (2, 3))


def test_next_page(spark):
    facts = {r.page_id: r for r in E.page_facts(parsed(
        spark, (f"{BASE}/c", '<div class="pager"><a class="next" href="/c?page=2">more</a></div>'),
        (f"{BASE}/d", '<div class="pager"><a class="next disabled" href="/d?page=9">more</a></div>'),
        (f"{BASE}/e", details("x")))).collect()}
    assert (facts[0].has_next, facts[0].next_url) == (True, f"{BASE}/c?page=2")
    assert (facts[1].has_next, facts[1].next_url) == (False, None)
    assert facts[2].page_title == "Potting shed"


def chain(copies):
    """Five linked pages of one card each, some stored `copies` times, and two pages that link to each other."""
    rows = []
    for n in range(1, 6):
        link = f'<div class="pager"><a class="next" href="/c?p={n + 1}">more</a></div>' if n < 5 else ""
        card = f'<div class="product-card"><h3><a href="/p/{n}">T{n}</a></h3></div>'
        for copy in range(copies if n in (1, 3) else 1):
            stale = "" if copy == copies - 1 or n not in (1, 3) else '<div class="product-card"><h3><a href="/p/old">Old</a></h3></div>'
            rows.append((100 * copy + n, f"{BASE}/c?p={n}", f"<title>Beds</title>{stale}{card}{link}"))
    rows += [(901, f"{BASE}/l1", '<a aria-label="Next" href="/l2">x</a>'), (902, f"{BASE}/l2", '<a aria-label="Next" href="/l1">x</a>')]
    return rows + [(950, f"{BASE}/bad", "<title>Bad</title><![foo bar]>"), (951, f"{BASE}/bad2", "<p><![if x]><p>")]


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_chains_with_copies_loops_and_broken_pages(spark, copies):
    categories, listed, broken = I.ingest_category(spark.createDataFrame(chain(copies), PAGES))
    assert {(r.source_url, r.title, r.product_count) for r in categories.collect()} == {
        (f"{BASE}/c?p=1", "Beds", 5), (f"{BASE}/l1", "Unknown Category", 0), (f"{BASE}/l2", "Unknown Category", 0),
        *(() if broken.filter(F.col("page_id") == 951).count() else {(f"{BASE}/bad2", "Unknown Category", 0)})}
    assert sorted(r.product_url for r in listed.collect()) == [f"{BASE}/p/{n}" for n in range(1, 6)]
    bad = {r.page_id: r.parse_error for r in broken.collect()}
    assert 950 in bad and bad[950]


def test_deep_pages_have_small_records(spark):
    html = '<div class="grid__item card">' * 50_000 + "<h1>Deep</h1>"
    frame = parsed(spark, (BASE, html), (f"{BASE}/next", details("Trowel")))
    size = frame.select(F.size("nodes").alias("n"), F.length(F.to_json("nodes")).alias("json")).collect()
    assert max(r.n for r in size) == 50_001 and max(r.json for r in size) < 250 * 50_001
    assert {r.title for r in E.product_details(frame).collect()} == {"Deep", "Trowel"}


def test_products_strict_and_lenient(spark):
    frame = spark.createDataFrame([(1, f"{BASE}/product/a", details("Sieve")), (2, f"{BASE}/product/b", "<p>none</p>"),
                                   (3, f"{BASE}/product/c", details("Gone") + "<![foo bar]>")], PAGES)
    kept = I.ingest_products(frame)
    assert [r.title for r in kept.rows.collect()] == ["Sieve"]
    assert [r.errors for r in kept.refused.collect()] == [["title: required"]]
    assert [r.page_id for r in kept.broken.collect()] == [3]
    for bad in (frame, frame.filter("page_id <> 2")):
        strict = I.ingest_products(bad, strict=True).rows
        for action in (strict.count, strict.select("source_url").collect, strict.select("source_url", "title").collect):
            with pytest.raises(Exception, match="validation failed"):
                action()
    good = I.ingest_products(frame.filter("page_id = 1"), strict=True)
    assert good.rows.count() == 1 and good.refused.count() == 0


def test_newest_row_of_a_page_counts(spark):
    frame = spark.createDataFrame([(1, f"{BASE}/product/a", details("New"), 5), (2, f"{BASE}/product/a", details("Old"), 4),
                                   (1, f"{BASE}/product/a", details("New"), 5)], PAGES + ", fetched_at int")
    assert [r.title for r in I.ingest_products(frame).rows.collect()] == ["New"]


def test_many_batches(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit(BASE + "/"), F.col("id")).alias("url"),
                                    F.concat(F.lit("<h1>T"), F.col("id"), F.lit("</h1>"), F.repeat(F.lit("x"), 60000)).alias("html"))
    got = E.product_details(E.parse_pages(pages.coalesce(1))).select("page_id", "title").collect()
    assert {(r.page_id, r.title) for r in got} == {(i, f"T{i}") for i in range(300)}


def test_pages_without_a_url_are_not_taken_for_one(spark):
    link = '<header><nav><a href="https://garden.example.com/{0}">{0}</a></nav></header>'
    pages = spark.createDataFrame([(1, None, link.format("spades")), (2, None, link.format("seeds")), (3, BASE, link.format("old")),
                                   (4, BASE, link.format("new")), (5, None, link.format("spades"))], PAGES)
    facts = E.parse_pages(E.with_recency(pages)).select("page_id", "url", E.menu().alias("menu"), *E.RECENCY)
    menus = E.catalogue_links(E.newest(facts, "t")).orderBy("page_id").collect()
    assert [r.source_url for r in menus] == [f"{BASE}/{x}" for x in ("spades", "seeds", "new", "spades")]
    refused = I.ingest_products(spark.createDataFrame([(i, None, details(f"Rake {i}")) for i in range(3)], PAGES)).refused
    assert refused.count() == 3


def test_no_html_is_moved_to_find_the_newest_crawl(spark):
    when = F.timestamp_seconds(F.col("id") % 7)
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit(f"{BASE}/product/"), F.col("id") % 6).alias("url"),
                                   F.concat(F.lit("<h1>T"), F.col("id"), F.lit("</h1>")).alias("html"), when.alias("fetched_at"))
    got = I.ingest_products(pages)
    rows = {r.source_url: r.title for r in got.rows.collect()}
    best = {}
    for i in range(60):
        best.setdefault(i % 6, []).append((i % 7, i))
    for k, crawls in best.items():
        last = [i for at, i in crawls if at == max(crawls)[0]]
        assert rows[f"{BASE}/product/{k}"] in {f"T{i}" for i in last}      # of one moment, any, but the same each time
    parsed = E.product_details(E.parse_pages(E.with_recency(pages)), keep=E.RECENCY)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_selectors_of_a_site(spark):
    markup = '<header><nav><a href="/x">Menu</a></nav></header><h2 class="name">Rake</h2><div class="deal"><i>9</i></div><i>7</i>'
    pages = spark.createDataFrame([(1, "https://a.example.com/1", markup), (2, "https://B.example.com/2", markup), (3, None, markup),
                                   (4, "https://b.example.com/4", None), (5, "https://b.example.com:8080/5", "<![foo bar]>")], PAGES)
    sites = spark.createDataFrame([("b.example.com", {"title": [".missing", "h2.name"], "price": [".deal i", "i"], "none": []})],
                                  "host string, selectors map<string,array<string>>")
    parsed = E.parse_by_site(pages, sites, {"title": ["header a"], "price": ["i"]})
    got = {r.page_id: r for r in parsed.select("page_id", E.picked_text("title").alias("t"), F.transform(E.picked("price"), lambda n: n["n"]).alias("p"),
                                               "parse_error").collect()}
    assert (got[1].t, got[2].t, got[3].t, got[4].t) == ("Menu", "Rake", "Menu", None)
    assert len(got[1].p) == 2 and len(got[2].p) == 1 and got[4].p == [] and got[5].parse_error


def test_a_handler_takes_the_place_of_the_parser(spark):
    def handler(batches):
        for batch in batches:
            kept = batch.drop_columns(["html"])
            upper = E.pa.array([(h or "").upper() for h in batch.column("html").to_pylist()], E.pa.string())
            empty = E._Elements()
            for _ in range(batch.num_rows):
                empty.read("")
            _, nodes, errors = empty.arrow()
            yield E.pa.RecordBatch.from_arrays([*kept.columns, upper, nodes, errors], names=[*kept.schema.names, "text", "nodes", "parse_error"])

    pages = spark.createDataFrame([(1, BASE, "<h1>a</h1>"), (2, BASE, None)], PAGES)
    assert {(r.page_id, r.text) for r in E.parse_pages(pages, handler=handler).collect()} == {(1, "<H1>A</H1>"), (2, "")}


def test_rendered_pages_are_dealt_to_all_cores(spark, sf_dir):
    """The tables that pages are rendered from are small files, each one task by its bytes."""
    from catalogspark.sources import adapters as A
    cores = spark.sparkContext.defaultParallelism
    for pages in (A.detail_page, A.category_list_page, A.listing_page):
        assert pages(spark, sf_dir).rdd.getNumPartitions() >= cores


def test_pages_of_different_sites_share_a_batch():
    batch = pa.RecordBatch.from_arrays([
        pa.array(["1", "2", "3"]), pa.array(["<h1>a</h1><p>b</p>", None, "<div id='x'><h1>c</h1></div>"]),
        pa.array([[("t", ["p"])], None, [("t", ["#x h1"])]], pa.map_(pa.string(), pa.list_(pa.string())))], names=["page_id", "html", "selectors"])
    [out] = E._parse_by_site(iter([batch]), {"t": ["h1"]})
    assert out.column("picked").to_pylist() == [[("t", [1])], [("t", [])], [("t", [1])]]
    assert [len(nodes) for nodes in out.column("nodes").to_pylist()] == [2, 0, 2]

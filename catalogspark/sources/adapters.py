"""The given tables seen as catalogue tables.

Every view is a plain projection (category adds one grouping), so filters and
column pruning still reach the Parquet scan underneath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..session import prepare, spread

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
SITE = "https://shop.example.com"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def events_as_of() -> Column:
    return F.lit(EVENTS_AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _ago(number: Column, unit: str) -> Column:
    return as_of() - F.make_dt_interval(**{f"{unit}": number.cast("int")})


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region > nation > supplier; every 50th supplier hangs on a parent that is not there."""
    region = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"),
        F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("key"))
    nation = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("key"))
    parent = F.when(F.col("s_suppkey") % 50 == 7, F.lit("n999")).otherwise(F.concat(F.lit("n"), "s_nationkey"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"),
        parent.alias("parent_id"), F.col("s_suppkey").alias("key"))
    stamp = _ago(F.col("key") % 40, "days")
    return region.unionByName(nation).unionByName(supplier).select(
        "id", "title", F.concat(F.lit(f"{SITE}/nav/"), "id").alias("source_url"), "parent_id",
        stamp.alias("last_scraped_at"), stamp.alias("created_at"), stamp.alias("updated_at"))


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category per brand, one empty category and one whose navigation row is missing."""
    brands = (table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.lit(1).alias("one"))
              .select("id", F.expr("cast(substring(id, 7) as int)").alias("no")))
    extra = spark.createDataFrame([("Brand#0", 0), ("Brand#99", 99)], "id string, no int")
    stamp = _ago(F.col("no") % 10, "days")
    nav = F.when(F.col("no") == 99, F.lit("n99")).otherwise(F.concat(F.lit("n"), F.col("no") % 25))
    return brands.unionByName(extra).select(
        "id", nav.alias("navigation_id"), F.concat(F.lit("Brand "), "no").alias("title"),
        F.concat(F.lit(f"{SITE}/collections/brand-"), "no").alias("source_url"),
        (F.col("no") * 3).cast("int").alias("product_count"),
        stamp.alias("last_scraped_at"), stamp.alias("created_at"), stamp.alias("updated_at"))


def _image_urls(key: str) -> Column:
    return F.expr(
        f"transform(slice(array(1, 2, 3), 1, cast({key} % 4 as int)),"
        f" i -> concat('https://cdn.example.com/img/', {key}, '-', i, '.jpg'))")


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part."""
    k = F.col("p_partkey")
    text = k.cast("string")
    specs = F.map_filter(
        F.create_map(
            F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"),
            F.lit("author"), F.concat(F.lit("Author "), (k % 50).cast("string")),
            F.lit("isbn"), F.when(k % 3 == 0, F.concat(F.lit("978"), text)),
            F.lit("pages"), F.when(k % 11 == 0, F.lit("n/a")).otherwise((k % 700 + 20).cast("string")),
            F.lit("format"), F.when(k % 2 == 0, F.lit("Paperback")).otherwise(F.lit("")),
        ),
        lambda _, v: v.isNotNull())
    created = _ago((k * 37) % 1000, "hours")
    scraped = _ago(k % 60, "days")
    return table(spark, sf_dir, "part").select(
        text.alias("id"),
        F.when(k % 23 == 0, None).when(k % 29 == 0, "Brand#404").otherwise(F.col("p_brand")).alias("category_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit(f"{SITE}/products/"), text).alias("source_url"),
        F.concat(F.lit("P"), text).alias("source_id"),
        F.when(k % 17 == 0, None).otherwise(F.col("p_retailprice")).cast("decimal(10,2)").alias("price"),
        F.when(k % 5 == 0, "USD").when(k % 7 == 0, "EUR").otherwise("GBP").alias("currency"),
        _image_urls("p_partkey").alias("image_urls"),
        F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("Summary of "), "p_name")).alias("summary"),
        specs.alias("specs"),
        (k % 10 != 0).alias("available"),
        scraped.alias("last_scraped_at"), created.alias("created_at"), scraped.alias("updated_at"))


def scrape_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl job per order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in S.JOB_TYPES]), (c % 3 + 1).cast("int"))
    code = F.col("o_orderstatus")
    status = (F.when(code == "O", "queued").when(code == "P", "running")
              .when(o % 5 == 0, "failed").otherwise("completed"))
    created = F.col("o_orderdate").cast("timestamp")
    updated = created + F.make_dt_interval(hours=(o % 72).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("j"), o.cast("string")).alias("id"), kind.alias("type"),
        F.concat(F.lit(f"{SITE}/"), kind, F.lit("/"), c.cast("string")).alias("target_url"),
        status.alias("status"), (o % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when((code == "F") & (o % 5 == 0) & (o % 2 == 0), F.concat(F.lit("timeout on "), o.cast("string")))
        .alias("last_error"),
        F.create_map(F.lit("customer"), c.cast("string")).alias("metadata"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.when(code == "P", _ago(o % 60, "mins")).alias("locked_at"),
        F.when(code == "P", F.concat(F.lit("worker-"), (c % 8).cast("string"))).alias("locked_by"),
        F.when(code == "F", updated).alias("completed_at"),
        created.alias("created_at"), updated.alias("updated_at"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    components = F.array(*[F.lit(c) for c in ("scraper", "crawler", "queue", "database", "storage")])
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "error", "error").when(kind == "signup", "warn").otherwise("info").alias("level"),
        F.element_at(components, (F.col("user_id") % 5 + 1).cast("int")).alias("component"),
        kind.alias("message"), F.col("props").alias("metadata"), "event_id")


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a session id of the form <epoch ms>-<user>: one session per user and day."""
    ts = F.col("ts").cast("timestamp")
    day_ms = F.unix_millis(F.date_trunc("day", ts))
    return table(spark, sf_dir, "events").select(
        "event_id", ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), "user_id",
        F.concat(day_ms.cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("event"), "value", "props")


def cache_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"),
        ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"),
        F.when(kind.isin("view", "purchase"), "hit").when(kind == "click", "stale")
        .when(kind == "signup", "miss").otherwise("error").alias("outcome"),
        "value", "event_id")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


# ---- shop pages that Spark renders from the part table -----------------------------------------

PAGE_KEYS = 200       # part keys per listing page group, so a page never has more cards than this
PAGES_PER_CHAIN = 5   # listing pages linked by "next" before the chain ends


def _chain_url(brand_no: Column, chain: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/collections/brand-"), brand_no, F.lit("-"), chain)


def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered category pages: product cards of one brand, chained by next links."""
    k = F.col("p_partkey")
    card = F.concat(
        F.lit('<div class="product-item"><a href="/products/'), k.cast("string"),
        F.lit('" class="product-title"><h3> '), F.col("p_name"), F.lit(' </h3></a><img src="/images/'),
        k.cast("string"), F.lit('.jpg" alt=""/><div class="price">'),
        F.when(k % 17 == 0, F.lit("Free"))
        .otherwise(F.concat(F.lit("£"), F.col("p_retailprice").cast("decimal(10,2)").cast("string"))),
        F.lit("</div></div>"))
    parts = table(spark, sf_dir, "part").withColumns({"no": F.substring("p_brand", 7, 10), "page_no": F.floor(k / PAGE_KEYS)})
    pages = (spread(parts, "no", "page_no").groupBy("no", "page_no")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), card.alias("c")))),
                                           lambda x: x["c"]), "\n").alias("cards")))
    chain = F.floor(F.col("page_no") / PAGES_PER_CHAIN)
    step = F.col("page_no") % PAGES_PER_CHAIN
    base = _chain_url(F.col("no"), chain.cast("string"))
    last = step == PAGES_PER_CHAIN - 1
    following = F.concat(F.regexp_replace(base, "^https://[^/]+", ""), F.lit("?page="), (step + 2).cast("string"))
    link = (F.when(last, F.lit('<a href="#" class="next disabled">Next</a>'))
            .otherwise(F.concat(F.lit('<a href="'), following, F.lit('" class="next">Next</a>'))))
    return pages.select(
        F.concat(F.col("no"), F.lit("/"), F.col("page_no").cast("string")).alias("page_id"),
        F.when(step == 0, base).otherwise(F.concat(base, F.lit("?page="), (step + 1).cast("string"))).alias("url"),
        F.concat(F.lit("<html><head><title>Brand "), "no",
                 F.lit('</title></head><body><div class="product-grid">'), "cards",
                 F.lit('</div><div class="pagination">'), link, F.lit("</div></body></html>")).alias("html"))


def recrawled(pages: DataFrame) -> DataFrame:
    """Pages as a crawl leaves them: every page, a third also with an older text, and for one in seven a broken page."""
    pages = pages.select("page_id", "url", "html")
    number = F.crc32(F.encode("url", "UTF-8"))
    older = pages.filter(number % 3 == 0).withColumn("html", F.concat(
        F.lit('<title>Old</title><div class="product-item"><a href="/products/gone">Gone</a></div><h1>Old</h1>'), F.col("html")))
    broken = pages.filter(number % 7 == 0).withColumn("url", F.concat("url", F.lit("#broken"))).withColumn(
        "html", F.concat(F.lit("<h1>Broken</h1><![foo bar]>"), F.col("html")))
    return (pages.withColumn("fetched_at", F.lit(2)).unionByName(older.withColumn("fetched_at", F.lit(1)))
            .unionByName(broken.withColumn("fetched_at", F.lit(2))))


def category_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered overview pages: one per 100 suppliers, a card per supplier with its item count."""
    k = F.col("s_suppkey")
    card = F.concat(
        F.lit('<a href="/collections/s'), k.cast("string"), F.lit('" class="category-item"><h3>'), F.col("s_name"),
        F.lit('</h3> <span class="product-count">('), (k % 90).cast("string"), F.lit(" books)</span></a>"))
    suppliers = table(spark, sf_dir, "supplier").withColumn("no", F.floor(k / 100))
    return (spread(suppliers, "no").groupBy("no")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), card.alias("c")))),
                                          lambda x: x["c"]), "\n").alias("cards"))
            .select(F.col("no").cast("string").alias("page_id"),
                    F.concat(F.lit(f"{SITE}/collections?group="), F.col("no").cast("string")).alias("url"),
                    F.concat(F.lit('<html><body><div class="category-list">'), "cards",
                             F.lit('<a href="#top">Top</a></div></body></html>')).alias("html")))


def detail_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered product pages; every 19th has no title, every 10th is out of stock."""
    k = F.col("p_partkey")
    text = k.cast("string")
    heading = F.when(k % 19 == 0, F.lit("")).otherwise(F.concat(F.lit('<h1 class="product-title">\n  '),
                                                                F.col("p_name"), F.lit("\n</h1>")))
    price = F.when(k % 17 == 0, F.lit("Free")).otherwise(
        F.concat(F.when(k % 5 == 0, F.lit("$")).otherwise(F.lit("£")),
                 F.col("p_retailprice").cast("decimal(10,2)").cast("string")))
    row = lambda name, value: F.concat(F.lit(f"<tr><td>{name}</td><td>"), value, F.lit("</td></tr>"))
    item = lambda name, value: F.concat(F.lit(f"<li>{name}: "), value, F.lit("</li>"))
    size = F.col("p_size").cast("string")
    specs = F.when(k % 2 == 0, F.concat(F.lit("<table>"), row("Cover Type", F.col("p_type")), row("Size", size),
                                        F.lit("</table>"))).otherwise(
        F.concat(F.lit("<ul>"), item("Cover Type", F.col("p_type")), item("Size", F.concat(size, F.lit(":1"))),
                 F.lit("</ul>")))
    stock = F.when(k % 10 == 0, F.lit("Out of Stock")).otherwise(F.lit("In Stock"))
    html = F.concat(
        F.lit('<html><head><title>Shop</title></head><body><div class="product-page">'), heading,
        F.lit('<div class="product-images"><img src="/img/'), text, F.lit('-a.jpg"><img src="/img/'), text,
        F.lit('-b.jpg"><img src="/img/'), text, F.lit('-a.jpg"></div><div class="price">'), price,
        F.lit('</div><div class="product-description"><p>About  '), F.col("p_name"),
        F.lit('</p></div><div class="product-specs">'), specs, F.lit('</div><div class="availability">'), stock,
        F.lit("</div></div></body></html>"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        text.alias("page_id"), F.concat(F.lit(f"{SITE}/product/"), text).alias("url"), html.alias("html"))

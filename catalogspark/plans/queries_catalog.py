"""Catalogue queries: pages of products, search, joins, tree, merges, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.stem import STOP_WORDS, stems_sql, words_sql
from ..operators import catalog as C, merge as M, tree as T, validate as V
from ..operators.search import search, write_index
from ..session import scratch_path
from ..sources import adapters as A, tables as R
from .registry import query
from .views_sql import AS_OF, SITE, with_views

# ---- product pages ---------------------------------------------------------------------------------

_ITEM = """id, title, CAST(price AS DOUBLE) AS price, currency,
 CASE WHEN len(image_urls) > 0 THEN image_urls[1] ELSE '' END AS thumbnail"""
_ITEM_COLUMNS = ["id", "title", "price", "currency", "thumbnail"]


def _page_sql(order: str, limit: int = 20, offset: int = 20, where: str = "available") -> str:
    return with_views(f"SELECT {_ITEM} FROM product WHERE {where} ORDER BY {order}, id LIMIT {limit} OFFSET {offset}",
                      "product")


def _register_page(name: str, sort: str, order: str) -> None:
    @query(f"product_page_{name}", _page_sql(order))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = C.product_page(A.product(spark, sf), sort, limit=20, offset=20, available=True)
        return rows.select(*_ITEM_COLUMNS)


_register_page("price_asc", "price_asc", "price ASC NULLS LAST")
_register_page("price_desc", "price_desc", "price DESC NULLS LAST")
_register_page("title_asc", "title_asc", "title ASC NULLS LAST")
_register_page("title_desc", "title_desc", "title DESC NULLS LAST")
_register_page("newest", "created_at_desc", "created_at DESC NULLS LAST")


@query("product_page_of_category", with_views(
    f"""SELECT {_ITEM}, (SELECT count(*) FROM product WHERE category_id = 'Brand#4') AS total
    FROM product WHERE category_id = 'Brand#4' ORDER BY price ASC NULLS LAST, id LIMIT 10""", "product"))
def product_page_of_category(spark, sf):
    products = A.product(spark, sf)
    page = C.product_page(products, "price_asc", limit=10, category_id="Brand#4")
    return C.with_total(page.select(*_ITEM_COLUMNS), C.in_category(products, "Brand#4"))


@query("product_sorted_price_desc", _page_sql("price DESC NULLS FIRST", limit=15, offset=5))
def product_sorted_price_desc(spark, sf):
    rows = C.product_page_sorted_by(A.product(spark, sf), "price", ascending=False, limit=15, offset=5)
    return rows.select(*_ITEM_COLUMNS)


@query("product_page_meta", with_views(
    """SELECT total, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS "limit",
    CAST(ceil(total / 20.0) AS BIGINT) AS total_pages, 3 < ceil(total / 20.0) AS has_next, true AS has_prev
    FROM (SELECT count(*) AS total FROM product WHERE available)""", "product"))
def product_page_meta(spark, sf):
    return C.page_meta(C.keep_available(A.product(spark, sf)), limit=20, offset=40)


@query("product_keyset", with_views(
    "SELECT id, title FROM product WHERE id > '15' ORDER BY id LIMIT 20", "product"))
def product_keyset(spark, sf):
    return C.keyset_page(A.product(spark, sf).select("id", "title"), "15")


@query("product_detail", with_views(
    """SELECT p.id, p.title, CAST(p.price AS DOUBLE) AS price, p.summary, c.title AS category_title,
    CAST(len(image_urls) AS INTEGER) AS images, spec_size AS size
    FROM product p LEFT JOIN category c ON p.category_id = c.id WHERE p.id = '42'""", "product", "category"))
def product_detail(spark, sf):
    row = C.product_detail(A.product(spark, sf), A.category(spark, sf), "42")
    return row.select("id", "title", F.col("price").cast("double").alias("price"), "summary", "category_title",
                      F.size("image_urls").alias("images"), F.element_at("specs", "size").alias("size"))


@query("product_available_states", with_views(
    """SELECT CAST(count(*) FILTER (available) AS BIGINT) AS yes, CAST(count(*) FILTER (NOT available) AS BIGINT) AS no,
    count(*) AS either FROM product""", "product"))
def product_available_states(spark, sf):
    products = A.product(spark, sf)
    count = lambda state: C.keep_available(products, state).agg(F.count(F.lit(1))).scalar()
    return products.agg(F.count(F.lit(1)).alias("either")).withColumns({"yes": count(True), "no": count(False)})


# ---- search ------------------------------------------------------------------------------------------

@query("product_search_ilike", with_views(
    """SELECT id, title, total FROM (
      SELECT id, title, count(*) OVER () AS total FROM product WHERE available AND title ILIKE '%BL_E%')
    ORDER BY title, id LIMIT 20 OFFSET 5""", "product"))
def product_search_ilike(spark, sf):
    hits = C.search_title(A.product(spark, sf), "BL_E").select("id", "title")
    page = C.page(hits, [F.col("title"), F.col("id")], 20, 5)
    return C.with_total(page, hits)


@query("product_search_ranked", with_views(
    r"""SELECT id, title, rank FROM (
      SELECT id, title, created_at, round(len(list_filter(words, lambda w: w IN ('blue', 'bolt'))) * 1.0 / len(words), 6) AS rank
      FROM (SELECT *, list_filter(regexp_split_to_array(lower(title), '\W+'), lambda w: w <> '') AS words
            FROM product WHERE available)
      WHERE list_contains(words, 'blue') AND list_contains(words, 'bolt'))
    ORDER BY rank DESC, created_at DESC, id LIMIT 20""", "product"))
def product_search_ranked(spark, sf):
    hits = C.search_ranked(A.product(spark, sf), "Blue bolt")
    order = [F.col("rank").desc(), F.col("created_at").desc(), F.col("id")]
    return C.page(hits, order, 20).select("id", "title", "rank")


@query("deep_page", """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 1000""")
def deep_page(spark, sf):
    """A page a thousand rows down."""
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return C.deep_page(orders, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], ["o_orderkey"], ["o_totalprice"], 100, 1000)


# Titles with plurals, stop words and words in between; the twin has the same rules in its own array functions.
_LONG_TITLE = """CASE {k} % 4 WHEN 0 THEN {title} WHEN 1 THEN 'Used ' || {title} || 's, and a ' || {title}
  WHEN 2 THEN replace({title}, ' ', ' or hand-painted ') || 's' ELSE {title} || ' in its finished ' || {type} || ' box' END"""
_TITLE_WORDS = words_sql("title", duck=True)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("product_search_text", with_views(
    f"""SELECT id, rank FROM (
      SELECT id, created_at, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(flatten(list_transform(one, lambda p: list_transform(two,
        lambda q: abs(p - q)))), lambda d: 1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2))))), lambda a, b: a * b), 6) AS rank
      FROM (SELECT id, created_at, list_filter(range(1, len(stems) + 1), lambda i: stems[i] = 'blue' AND words[i] NOT IN ({_STOP})) AS one,
              list_filter(range(1, len(stems) + 1), lambda i: stems[i] = 'ring' AND words[i] NOT IN ({_STOP})) AS two
            FROM (SELECT *, {stems_sql("words", duck=True)} AS stems FROM titled)) WHERE len(one) > 0 AND len(two) > 0)
    ORDER BY rank DESC, created_at DESC, id LIMIT 20""", "product",
    titled=f"SELECT id, created_at, {_TITLE_WORDS} AS words FROM (SELECT id, created_at, {_LONG_TITLE.format(k='k', title='title', type='spec_type')} AS title "
           "FROM product WHERE available)"))
def product_search_text(spark, sf):
    """Words of a query in any form, over an index that is written for it."""
    title = _LONG_TITLE.format(k="CAST(id AS BIGINT)", title="title", type="specs['type']")
    products = A.product(spark, sf).withColumn("title", F.expr(title))
    path = scratch_path(spark, "title-index")
    write_index(products, path)
    order = [F.col("rank").desc(), F.col("created_at").desc(), F.col("id")]
    return C.page(search(products, path, "the blue rings"), order, 20).select("id", "rank")


@query("product_specs_eq", with_views("SELECT id FROM product WHERE spec_author = 'Author 7'", "product"))
def product_specs_eq(spark, sf):
    return C.spec_equals(A.product(spark, sf), "author", "Author 7").select("id")


@query("product_specs_has_key", with_views("SELECT id FROM product WHERE spec_isbn IS NOT NULL", "product"))
def product_specs_has_key(spark, sf):
    return C.spec_has_key(A.product(spark, sf), "isbn").select("id")


@query("product_specs_contains", with_views(
    "SELECT id FROM product WHERE spec_author = 'Author 8' AND spec_format = 'Paperback'", "product"))
def product_specs_contains(spark, sf):
    return C.spec_contains(A.product(spark, sf), {"author": "Author 8", "format": "Paperback"}).select("id")


@query("product_specs_as_text", with_views(
    "SELECT id FROM product WHERE spec_author = 'Author 11' OR spec_type = 'Author 11'", "product"))
def product_specs_as_text(spark, sf):
    return C.spec_text_contains(A.product(spark, sf), '"Author 11"').select("id")


@query("specs_clean", with_views(
    """SELECT p.id, s.label, s.value FROM product p, LATERAL (VALUES ('Type', spec_type), ('Size', spec_size),
      ('Author', spec_author), ('ISBN', spec_isbn), ('Pages', spec_pages), ('Format', spec_format)) AS s(label, value)
    WHERE s.value IS NOT NULL AND s.value <> ''""", "product"))
def specs_clean(spark, sf):
    return (A.product(spark, sf).select("id", F.explode(C.clean_specs(F.col("specs"))).alias("key", "value"))
            .select("id", X.spec_label(F.col("key")).alias("label"), "value"))


@query("specs_typed", with_views(
    """SELECT id, spec_author AS author, spec_isbn AS isbn, TRY_CAST(spec_pages AS INTEGER) AS pages,
    spec_format AS format, CAST(NULL AS VARCHAR) AS publisher, 'en' AS language, CAST(NULL AS VARCHAR) AS publication_date,
    CAST(NULL AS VARCHAR) AS dimensions, k % 900 || ' g' AS weight FROM product""", "product"))
def specs_typed(spark, sf):
    more = F.create_map(F.lit("language"), F.lit("en"), F.lit("weight"),
                        F.concat((F.col("id").cast("bigint") % 900).cast("string"), F.lit(" g")))
    document = F.try_parse_json(F.to_json(X.merge_maps(F.col("specs"), more)))
    return A.product(spark, sf).select("id", *[c.alias(n) for n, c in C.typed_specs(document).items()])


@query("purge_prefix", with_views(
    f"SELECT count(*) AS kept, count(*) FILTER (k % 10 = 0) AS without_url FROM product WHERE k % 10 = 0 OR source_url NOT LIKE '{SITE}/products/1%'", "product"))
def purge_prefix(spark, sf):
    rows = A.product(spark, sf).withColumn("source_url", F.when(F.col("id").cast("bigint") % 10 != 0, F.col("source_url")))
    return C.purge_prefix(rows, f"{SITE}/products/1%").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(F.col("source_url").isNull()).alias("without_url"))


# ---- joins ---------------------------------------------------------------------------------------------

@query("category_with_nav", with_views(
    """SELECT c.id, c.title, n.title AS navigation_title, n.parent_id AS navigation_parent_id,
      product_count || CASE WHEN product_count = 1 THEN ' product' ELSE ' products' END AS label
    FROM category c LEFT JOIN navigation n ON c.navigation_id = n.id""", "category", "navigation"))
def category_with_nav(spark, sf):
    rows = C.categories_with_navigation(A.category(spark, sf), A.navigation(spark, sf))
    return rows.select("id", "title", "navigation_title", "navigation_parent_id",
                       X.count_label(F.col("product_count")).alias("label"))


@query("category_by_parent", with_views(
    """SELECT id, title FROM category WHERE navigation_id IN (SELECT id FROM navigation WHERE parent_id = 'r1')
    ORDER BY title, id LIMIT 20""", "category", "navigation"))
def category_by_parent(spark, sf):
    rows = C.categories_under(A.category(spark, sf), A.navigation(spark, sf), "r1").select("id", "title")
    return C.page(rows, [F.col("title"), F.col("id")], 20)


@query("category_products", with_views(
    f"""SELECT p.{_ITEM.replace(' title', ' p.title', 1)}, c.title AS category_title
    FROM product p JOIN category c ON p.category_id = c.id WHERE c.id = 'Brand#7' AND p.available
    ORDER BY p.created_at DESC, p.id LIMIT 20""", "product", "category"))
def category_products(spark, sf):
    rows = C.products_of_category(A.product(spark, sf), A.category(spark, sf), "Brand#7")
    top = C.page(rows, [F.col("created_at").desc(), F.col("id")], 20)
    return top.select("id", "title", F.col("price").cast("double").alias("price"), "currency",
                      F.coalesce(X.first_of(F.col("image_urls")), F.lit("")).alias("thumbnail"), "category_title")


@query("active_products", with_views(
    f"""SELECT p.id, p.title, c.title AS category_title, n.title AS navigation_title FROM product p
    JOIN category c ON p.category_id = c.id JOIN navigation n ON c.navigation_id = n.id
    WHERE p.available AND p.last_scraped_at > {AS_OF} - INTERVAL 30 DAY""", "product", "category", "navigation"))
def active_products(spark, sf):
    rows = C.active_products(A.product(spark, sf), A.category(spark, sf), A.navigation(spark, sf), A.as_of())
    return rows.select("id", "title", "category_title", "navigation_title")


@query("dangling_fk_counts", with_views(
    """SELECT 'product' AS child, count(*) AS dangling FROM product
      WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM category)
    UNION ALL SELECT 'category', count(*) FROM category WHERE navigation_id NOT IN (SELECT id FROM navigation)""",
    "product", "category", "navigation"))
def dangling_fk_counts(spark, sf):
    products, categories = A.product(spark, sf), A.category(spark, sf)
    lost = C.dangling_count(products, "category_id", categories).withColumn("child", F.lit("product"))
    return lost.unionByName(C.dangling_count(categories, "navigation_id", A.navigation(spark, sf))
                            .withColumn("child", F.lit("category")))


@query("orphan_products", with_views(
    "SELECT p.id, p.title FROM product p LEFT JOIN category c ON p.category_id = c.id WHERE c.id IS NULL",
    "product", "category"))
def orphan_products(spark, sf):
    return C.orphans(A.product(spark, sf), "category_id", A.category(spark, sf)).select("id", "title")


# ---- tree ------------------------------------------------------------------------------------------------

_TREE = """SELECT id, title, parent_id, [id] AS path, [title] AS titles, 0 AS depth FROM navigation WHERE parent_id IS NULL
  UNION ALL SELECT n.id, n.title, n.parent_id, list_append(t.path, n.id), list_append(t.titles, n.title), t.depth + 1
  FROM navigation n JOIN tree t ON n.parent_id = t.id"""


@query("nav_tree", with_views(
    """SELECT id, title, depth, array_to_string(path, '>') AS path, array_to_string(titles, '>') AS title_path FROM tree""",
    "navigation", tree=_TREE, recursive=True))
def nav_tree(spark, sf):
    return T.hierarchy(A.navigation(spark, sf)).select(
        "id", "title", "depth", F.array_join("path", ">").alias("path"), F.array_join("title_path", ">").alias("title_path"))


@query("nav_display_order", with_views(
    """SELECT id, CAST(row_number() OVER (ORDER BY titles, path) AS BIGINT) AS position FROM tree""", "navigation", tree=_TREE, recursive=True))
def nav_display_order(spark, sf):
    """The place of each node when the tree is listed: parents first, siblings by title."""
    return T.display_positions(T.hierarchy(A.navigation(spark, sf)))


@query("nav_search", with_views(
    """SELECT id, title FROM tree t WHERE EXISTS (SELECT 1 FROM matched m WHERE list_contains(m.path, t.id))
      OR EXISTS (SELECT 1 FROM matched m WHERE list_contains(t.path, m.id)
        AND NOT EXISTS (SELECT 1 FROM matched d WHERE d.id <> m.id AND list_contains(d.path, m.id)))""",
    "navigation", tree=_TREE, matched="SELECT id, path FROM tree WHERE contains(lower(title), 'on_1')", recursive=True))
def nav_search(spark, sf):
    return T.search_tree(T.hierarchy(A.navigation(spark, sf)), "ON_1").select("id", "title")


@query("nav_cascade_delete", with_views(
    """SELECT 'navigation' AS kind, count(*) AS n FROM navigation WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'category', count(*) FROM category WHERE navigation_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'product', count(*) FROM product
    UNION ALL SELECT 'product_with_category', count(*) FROM product WHERE category_id IS NOT NULL
      AND category_id NOT IN (SELECT id FROM category WHERE navigation_id IN (SELECT id FROM gone))""",
    "navigation", "category", "product",
    gone="""SELECT id FROM navigation WHERE id IN ('r1', 'n7')
      UNION SELECT n.id FROM navigation n JOIN gone g ON n.parent_id = g.id""", recursive=True))
def nav_cascade_delete(spark, sf):
    navigation = A.navigation(spark, sf)
    doomed = navigation.filter(F.col("id").isin("r1", "n7"))
    nav, cat, prod = T.cascade_delete(navigation, A.category(spark, sf), A.product(spark, sf), doomed)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return (count(nav, "navigation").unionByName(count(cat, "category")).unionByName(count(prod, "product"))
            .unionByName(count(prod.filter(F.col("category_id").isNotNull()), "product_with_category")))


# ---- counts and merges --------------------------------------------------------------------------------

@query("category_counts", with_views(
    """SELECT c.id, CAST(count(p.id) AS INTEGER) AS product_count FROM category c
    LEFT JOIN product p ON p.category_id = c.id GROUP BY c.id""", "category", "product"))
def category_counts(spark, sf):
    return M.refresh_product_counts(A.category(spark, sf), A.product(spark, sf)).select("id", "product_count")


def change_feed(products: DataFrame) -> DataFrame:
    """A change feed derived from the products: inserts, deletes and moves to category Brand#1."""
    k = F.col("id").cast("bigint")
    op = F.when(k % 3 == 0, "insert").when(k % 3 == 1, "delete").otherwise("move")
    return products.select(
        F.col("id").alias("product_id"), op.alias("op"), F.when(op != "insert", F.col("category_id")).alias("old_category_id"),
        F.when(op == "insert", F.col("category_id")).when(op == "move", "Brand#1").alias("new_category_id"))


_SIGNED = """SELECT category_id, CASE WHEN k % 3 = 0 THEN 1 ELSE -1 END AS delta FROM product
  UNION ALL SELECT 'Brand#1', 1 FROM product WHERE k % 3 = 2"""


@query("category_counts_delta", with_views(
    """SELECT id, CAST(product_count + coalesce((SELECT sum(delta) FROM signed s WHERE s.category_id = c.id), 0) AS INTEGER)
      AS product_count FROM category c""", "category", "product", signed=_SIGNED))
def category_counts_delta(spark, sf):
    rows = M.apply_count_changes(A.category(spark, sf), change_feed(A.product(spark, sf)))
    return rows.select("id", "product_count")


def scraped_products(spark: SparkSession, sf: str) -> DataFrame:
    """Scraped rows derived from the parts: two versions of two thirds of the products, and new ones."""
    part = A.table(spark, sf, "part").filter(F.col("p_partkey") % 3 != 2)
    k = F.col("p_partkey")
    both = part.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    number = F.when(k % 9 == 0, k + 100_000_000).otherwise(k)
    return both.select(
        F.concat(F.lit(f"{SITE}/products/"), number.cast("string")).alias("source_url"),
        F.concat(F.col("p_name"), F.lit(" v"), F.col("round").cast("string")).alias("title"),
        F.when(k % 2 == 0, F.col("p_retailprice") + F.col("round")).cast("decimal(10,2)").alias("price"),
        F.when(k % 6 == 0, F.lit("EUR")).alias("currency"), F.lit(None).cast("string").alias("summary"),
        "round")


_SCRAPED = f"""SELECT '{SITE}/products/' || CASE WHEN p_partkey % 9 = 0 THEN p_partkey + 100000000 ELSE p_partkey END
    AS source_url, p_name || ' v2' AS title,
    CAST(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 2 END AS DECIMAL(10,2)) AS price,
    CASE WHEN p_partkey % 6 = 0 THEN 'EUR' END AS currency
  FROM part WHERE p_partkey % 3 <> 2"""


def _upsert_sql(title: str, price: str, currency: str, summary: str, available: str) -> str:
    return with_views(
        f"""SELECT source_url, {title} AS title, CAST({price} AS DOUBLE) AS price, {currency} AS currency,
        {summary} AS summary, {available} AS available,
        CASE WHEN s.source_url IS NULL THEN 'keep' WHEN p.source_url IS NULL THEN 'insert' ELSE 'update' END AS action
        FROM product p FULL OUTER JOIN scraped s USING (source_url)""", "product", scraped=_SCRAPED)


def _register_upsert(name: str, mode: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        merged = M.upsert(A.product(spark, sf), scraped_products(spark, sf), "product", A.as_of(), ["round"], mode)
        return merged.select("source_url", "title", F.col("price").cast("double").alias("price"), "currency", "summary",
                             "available", "action")


_HIT = "s.source_url IS NOT NULL"
_register_upsert("product_upsert", "overwrite", _upsert_sql(
    "coalesce(s.title, p.title)", "coalesce(s.price, p.price)",
    f"CASE WHEN {_HIT} THEN coalesce(s.currency, 'GBP') ELSE p.currency END", "p.summary", "coalesce(p.available, true)"))
_register_upsert("product_upsert_all", "overwrite_all", _upsert_sql(
    f"CASE WHEN {_HIT} THEN s.title ELSE p.title END", f"CASE WHEN {_HIT} THEN s.price ELSE p.price END",
    f"CASE WHEN {_HIT} THEN coalesce(s.currency, 'GBP') ELSE p.currency END",
    f"CASE WHEN {_HIT} THEN NULL ELSE p.summary END", "coalesce(p.available, true)"))
_register_upsert("product_upsert_fill_only", "fill_only", _upsert_sql(
    "coalesce(p.title, s.title)", "coalesce(p.price, s.price)", "coalesce(p.currency, s.currency, 'GBP')", "p.summary",
    "coalesce(p.available, true)"))


@query("nav_upsert", with_views(
    f"""SELECT source_url, coalesce(s.title, n.title) AS title, coalesce(s.parent_id, n.parent_id) AS parent_id,
      s.source_url IS NOT NULL AS touched
    FROM navigation n FULL OUTER JOIN (
      SELECT '{SITE}/nav/s' || CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS source_url,
        'New ' || s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'n1' END AS parent_id FROM supplier) s
    USING (source_url)""", "navigation"))
def nav_upsert(spark, sf):
    k = F.col("s_suppkey")
    number = F.when(k % 5 == 0, k + 1_000_000).otherwise(k)
    scraped = A.table(spark, sf, "supplier").select(
        F.concat(F.lit(f"{SITE}/nav/s"), number.cast("string")).alias("source_url"),
        F.concat(F.lit("New "), "s_name").alias("title"), F.when(k % 2 == 0, F.lit("n1")).alias("parent_id"))
    merged = M.upsert(A.navigation(spark, sf), scraped, "navigation", A.as_of(), ["title"])
    return merged.select("source_url", "title", "parent_id", (F.col("action") != "keep").alias("touched"))


@query("category_upsert", with_views(
    f"""SELECT source_url, coalesce(s.title, c.title) AS title, coalesce(s.product_count, c.product_count) AS product_count
    FROM category c FULL OUTER JOIN (
      SELECT '{SITE}/collections/brand-' || substr(p_brand, 7) AS source_url, max('Fresh ' || p_brand) AS title,
        CAST(count(*) AS INTEGER) AS product_count FROM part GROUP BY p_brand) s USING (source_url)""", "category"))
def category_upsert(spark, sf):
    scraped = A.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("product_count")).select(
        F.concat(F.lit(f"{SITE}/collections/brand-"), F.substring("p_brand", 7, 10)).alias("source_url"),
        F.concat(F.lit("Fresh "), "p_brand").alias("title"), F.col("product_count").cast("int").alias("product_count"))
    merged = M.upsert(A.category(spark, sf), scraped, "category", A.as_of(), ["title"])
    return merged.select("source_url", "title", "product_count")


@query("point_updates", with_views(
    """SELECT id, CASE WHEN k % 4 = 0 THEN false WHEN k % 4 = 1 THEN true ELSE available END AS available,
      CASE WHEN k % 4 = 0 THEN 'USD' ELSE currency END AS currency, CASE WHEN k % 4 = 1 THEN NULL ELSE summary END AS summary,
      k % 4 < 2 AS stamped FROM product""", "product"))
def point_updates(spark, sf):
    products = A.product(spark, sf)
    k = F.col("id").cast("bigint")
    changes = products.filter(k % 4 < 2).select("id", (k % 4 == 1).alias("available"),
                                                F.when(k % 4 == 0, "USD").alias("currency"),
                                                F.when(k % 4 == 1, F.array(F.lit("summary"))).alias("cleared"))
    changed = M.apply_changes(products, changes, as_of=A.as_of(), cleared="cleared")
    return changed.select("id", "available", "currency", "summary", (F.col("updated_at") == A.as_of()).alias("stamped"))


# ---- validation ------------------------------------------------------------------------------------------

def dirty_products(spark: SparkSession, sf: str) -> DataFrame:
    """Scraped product rows with faults planted by part key."""
    k = F.col("p_partkey")
    text = k.cast("string")
    return A.table(spark, sf, "part").select(
        text.alias("id"),
        F.when(k % 13 == 0, "").when(k % 13 == 1, F.repeat(F.lit("t"), 501)).otherwise(F.col("p_name")).alias("title"),
        F.when(k % 17 == 0, "nowhere").otherwise(F.concat(F.lit(f"{SITE}/products/"), text)).alias("source_url"),
        F.when(k % 19 == 0, -1.0).when(k % 19 == 1, 0.0).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(k % 23 == 0, "POUND").when(k % 23 == 1, "JPY").otherwise("GBP").alias("currency"),
        F.when(k % 29 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit(f"{SITE}/a.jpg"))).alias("image_urls"),
        F.when(k % 29 == 1, '{"a": 1}').otherwise('["a"]').alias("image_json"),
        F.when(k % 31 == 0, F.repeat(F.lit("s"), 2001)).alias("summary"),
        F.when(k % 37 == 0, "not-a-uuid").when(k % 37 == 1, "550e8400-e29b-41d4-a716-446655440000").alias("category_id"))


_FAULTS = {
    "title: required": "k % 13 = 0", "title: longer than 500": "k % 13 = 1", "source_url: invalid url": "k % 17 = 0",
    "price: not positive": "k % 19 IN (0, 1)", "currency: not 3 letters": "k % 23 = 0",
    "image_urls: invalid url": "k % 29 = 0", "summary: longer than 2000": "k % 31 = 0",
    "category_id: invalid uuid": "k % 37 = 0"}


def _faults(*skip: str) -> str:
    cases = [f"CASE WHEN {c} THEN '{m}' END" for m, c in _FAULTS.items() if m not in skip]
    return f"SELECT CAST(k AS VARCHAR) AS id, list_filter([{', '.join(cases)}], lambda e: e IS NOT NULL) AS errors FROM (SELECT p_partkey AS k FROM part)"


@query("validate_products", f"""SELECT id, array_to_string(errors, '; ') AS errors FROM (
  {_faults('title: longer than 500', 'summary: longer than 2000')}) WHERE len(errors) > 0""")
def validate_products(spark, sf):
    _, refused = V.split_valid(dirty_products(spark, sf), V.rules("write_product"))
    return refused.select("id", F.array_join("errors", "; ").alias("errors"))


@query("validate_strict", f"SELECT id, errors[1] AS error FROM ({_faults()})")
def validate_strict(spark, sf):
    return V.first_error(dirty_products(spark, sf), V.rules("strict_product")).select("id", "error")


@query("db_checks", """SELECT count(*) FILTER (p_partkey % 19 = 0) AS check_price_positive,
  count(*) FILTER (p_partkey % 23 IN (0, 1)) AS check_currency_valid,
  count(*) FILTER (p_partkey % 41 = 0) AS check_image_urls_array, count(*) FILTER (p_partkey % 29 = 1) AS image_json FROM part""")
def db_checks(spark, sf):
    rows = dirty_products(spark, sf).withColumn("image_urls", F.when(F.col("id").cast("bigint") % 41 != 0, F.col("image_urls")))
    (_, bad_json), = [V.check_images_json("image_json")]
    return V.count_violations(rows, [*V.rules("check_product"), ("image_json", bad_json)])


def dirty_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl jobs with faults planted by order key."""
    k = F.substring("id", 2, 20).cast("bigint")
    return A.scrape_job(spark, sf).withColumns({
        "type": F.when(k % 11 == 0, "image").otherwise(F.col("type")),
        "status": F.when(k % 13 == 0, "lost").otherwise(F.col("status")),
        "attempts": F.when(k % 17 == 0, -1).otherwise(F.col("attempts")).cast("int"),
        "target_url": F.when(k % 19 == 0, "nowhere").otherwise(F.col("target_url")),
        "priority": F.when(k % 23 == 0, 11).when(k % 29 == 0, F.lit(None)).otherwise(F.col("priority")).cast("int")})


@query("db_checks_jobs", """SELECT count(*) FILTER (o_orderkey % 11 = 0) AS check_type, count(*) FILTER (o_orderkey % 13 = 0) AS check_status FROM orders""")
def db_checks_jobs(spark, sf):
    return V.count_violations(dirty_jobs(spark, sf), V.rules("check_job"))


def _errors_sql(cases: dict[str, str], source: str) -> str:
    listed = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in cases.items())
    return f"""SELECT id, array_to_string(errors, '; ') AS errors FROM (
      SELECT id, list_filter([{listed}], lambda e: e IS NOT NULL) AS errors FROM ({source})) WHERE len(errors) > 0"""


def _refused(rows: DataFrame, ruleset: str) -> DataFrame:
    return V.split_valid(rows, V.rules(ruleset))[1].select("id", F.array_join("errors", "; ").alias("errors"))


_JOB_ROWS = "SELECT 'j' || o_orderkey AS id, o_orderkey AS k FROM orders"


@query("validate_jobs", _errors_sql({"status: not one of queued, running, completed, failed": "k % 13 = 0", "attempts: negative": "k % 17 = 0"}, _JOB_ROWS))
def validate_jobs(spark, sf):
    return _refused(dirty_jobs(spark, sf), "write_job")


@query("validate_jobs_strict", _errors_sql({"type: not one of navigation, category, product": "k % 11 = 0", "target_url: invalid url": "k % 19 = 0",
                                            "priority: not in 1..10": "k % 23 = 0"}, _JOB_ROWS))
def validate_jobs_strict(spark, sf):
    return _refused(dirty_jobs(spark, sf), "strict_job")


def dirty_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Scraped category (and navigation) rows, one per supplier, with faults planted by its key."""
    k = F.col("s_suppkey")
    return A.table(spark, sf, "supplier").select(
        k.cast("string").alias("id"), F.when(k % 5 == 0, "").when(k % 5 == 1, F.repeat(F.lit("t"), 201)).otherwise(F.col("s_name")).alias("title"),
        F.when(k % 7 == 0, "nowhere").otherwise(F.concat(F.lit(f"{SITE}/c/"), k.cast("string"))).alias("source_url"),
        F.when(k % 11 == 0, -1).otherwise(3).alias("product_count"),
        F.when(k % 13 == 0, "x").alias("navigation_id"), F.when(k % 13 == 0, "x").alias("parent_id"))


_SUPPLIER_ROWS = "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS k FROM supplier"
_TITLE, _LONG, _URL = ({"title: required": "k % 5 = 0"}, {"title: longer than 200": "k % 5 = 1"}, {"source_url: invalid url": "k % 7 = 0"})
_COUNT, _NAV, _PARENT = ({"product_count: negative": "k % 11 = 0"}, {"navigation_id: invalid uuid": "k % 13 = 0"},
                         {"parent_id: invalid uuid": "k % 13 = 0"})


@query("validate_categories", _errors_sql(_TITLE | _URL | _NAV | _COUNT, _SUPPLIER_ROWS))
def validate_categories(spark, sf):
    return _refused(dirty_categories(spark, sf), "write_category")


@query("validate_categories_strict", _errors_sql(_TITLE | _LONG | _URL | _COUNT | _NAV, _SUPPLIER_ROWS))
def validate_categories_strict(spark, sf):
    return _refused(dirty_categories(spark, sf), "strict_category")


@query("validate_navigation", _errors_sql(_TITLE | _URL | _PARENT, _SUPPLIER_ROWS))
def validate_navigation(spark, sf):
    return _refused(dirty_categories(spark, sf), "write_navigation")


@query("validate_navigation_strict", _errors_sql(_TITLE | _LONG | _URL | _PARENT, _SUPPLIER_ROWS))
def validate_navigation_strict(spark, sf):
    return _refused(dirty_categories(spark, sf), "strict_navigation")


@query("user_rules", """SELECT CAST(p_partkey AS VARCHAR) AS id, 'size: odd' AS error FROM part WHERE p_size % 2 = 1""")
def user_rules(spark, sf):
    rows = A.table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string"))
    checked = V.first_error(rows, [("size: odd", F.col("p_size") % 2 == 1)])
    return checked.filter(F.col("error").isNotNull()).select("id", "error")


@query("text_scalars", with_views(
    r"""SELECT id, CASE WHEN price IS NULL THEN 'Price not available' ELSE
        CASE currency WHEN 'USD' THEN 'US$' WHEN 'EUR' THEN '€' ELSE '£' END || format('{:,.2f}', CAST(price AS DOUBLE)) END
        AS price_label,
      CASE WHEN length(title) <= 8 THEN title ELSE trim(substr(title, 1, 8)) || '...' END AS short_title,
      regexp_replace(lower(title), '[^a-z0-9]', '_', 'g') AS key,
      CAST(regexp_extract(spec_size || ' items', '(\d+)', 1) AS INTEGER) AS n,
      NOT contains(CASE WHEN available THEN 'in stock' ELSE 'out of stock' END, 'out of stock') AS available,
      title || 'b' AS safe, 'size' AS spec_name, spec_size || ':1' AS spec_value FROM product""", "product"))
def text_scalars(spark, sf):
    pair = X.spec_pair(F.concat(F.lit("Size: "), F.element_at("specs", "size"), F.lit(":1")))
    return A.product(spark, sf).select(
        "id", X.format_price(F.col("price"), F.col("currency")).alias("price_label"),
        X.truncate(F.col("title"), 8).alias("short_title"), X.spec_key(F.col("title")).alias("key"),
        X.item_count(F.concat(F.element_at("specs", "size"), F.lit(" items"))).alias("n"),
        X.is_available(F.when(F.col("available"), "In Stock").otherwise("Out of stock")).alias("available"),
        X.sanitize(F.concat(F.lit("  <"), "title", F.lit(">b "))).alias("safe"),
        pair["key"].alias("spec_name"), pair["value"].alias("spec_value"))


@query("relative_time", with_views(
    f"""SELECT id, CASE WHEN s < 60 THEN 'Just now'
      WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 > 1 THEN 's' ELSE '' END || ' ago'
      WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END || ' ago'
      WHEN s < 604800 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END || ' ago'
      ELSE strftime(created_at, '%d/%m/%Y') END AS age
    FROM (SELECT id, created_at, CAST(epoch({AS_OF}) - epoch(created_at) AS BIGINT) AS s FROM product)""", "product"))
def relative_time(spark, sf):
    return A.product(spark, sf).select("id", X.relative_time(F.col("created_at"), A.as_of()).alias("age"))


@query("scan_projected", "SELECT p_partkey, p_name FROM part")
def scan_projected(spark, sf):
    return R.read_table(spark, f"{sf}/part.parquet").select("p_partkey", "p_name")


@query("synthetic_products", """SELECT 'test-' || (p_partkey + 1) AS source_id, 'Test Book ' || (p_partkey + 1) AS title,
  'Test Author ' || (p_partkey // 10 + 1) AS author, '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn,
  'cat-' || (p_partkey % 5 + 1) AS category_id, true AS price_ok FROM part""")
def synthetic_products(spark, sf):
    made = R.synthetic_products(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), f"{SITE}/books")
    return made.select("source_id", "title", F.element_at("specs", "author").alias("author"),
                       F.element_at("specs", "isbn").alias("isbn"), "category_id",
                       F.col("price").between(5, 55.01).alias("price_ok"))


@query("union_pages", with_views(
    """SELECT id, count(*) AS n FROM (
      (SELECT id FROM product ORDER BY title, id LIMIT 20) UNION ALL (SELECT id FROM product ORDER BY price NULLS LAST, id LIMIT 20))
    GROUP BY id""", "product"))
def union_pages(spark, sf):
    products = A.product(spark, sf)
    first = C.product_page(products, "title_asc").select("id")
    return first.unionByName(C.product_page(products, "price_asc").select("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"))

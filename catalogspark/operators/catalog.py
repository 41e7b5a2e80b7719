"""Catalogue reads: filter, project, search, join, sort and page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import first_of
from ..session import written

PRODUCT_SORTS = {
    "price_asc": lambda: F.col("price").asc_nulls_last(),
    "price_desc": lambda: F.col("price").desc_nulls_last(),
    "title_asc": lambda: F.col("title").asc_nulls_last(),
    "title_desc": lambda: F.col("title").desc_nulls_last(),
    "created_at_desc": lambda: F.col("created_at").desc_nulls_last(),
}
DEFAULT_SORT, DEFAULT_LIMIT, MAX_LIMIT = "created_at_desc", 20, 100
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID_PATTERN)


def check_page(limit: int = DEFAULT_LIMIT, offset: int = 0, sort: str = DEFAULT_SORT, **ids: str | None) -> None:
    """Refuse bad arguments before any plan is built; ids given here must be uuids."""
    problems = []
    if not 1 <= limit <= MAX_LIMIT:
        problems.append(f"limit: must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        problems.append("offset: must be at least 0")
    if sort not in PRODUCT_SORTS:
        problems.append(f"sort: must be one of {', '.join(PRODUCT_SORTS)}")
    problems += [f"{name}: invalid uuid" for name, value in ids.items()
                 if value is not None and not re.match(UUID_PATTERN, value)]
    if problems:
        raise ValueError("Validation error: " + ", ".join(problems))


def keep_available(products: DataFrame, available: bool | None = True) -> DataFrame:
    return products if available is None else products.filter(F.col("available") == available)


def in_category(products: DataFrame, category_id: str | None) -> DataFrame:
    return products if category_id is None else products.filter(F.col("category_id") == category_id)


def by_key(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Zero or one row: an unknown key gives an empty frame."""
    return df.filter(F.col(column) == value).limit(1)


def list_item(products: DataFrame) -> DataFrame:
    return products.select(
        "id", "title", F.col("price").cast("double").alias("price"), "currency",
        F.coalesce(first_of(F.col("image_urls")), F.lit("")).alias("thumbnail"), "available", "created_at")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def deep_page(df: DataFrame, order: list[Column], key: list[str], columns: list[str], limit: int, offset: int) -> DataFrame:
    """The rows offset + 1 ... offset + limit in an order, however far down, without sorting or gathering what is before.

    Only the columns that the order reads are dealt into ranges and counted; the counts tell which ranges hold the page,
    and only those are sorted, each by its task.  The page's rows are then fetched by key, which must be unique and without
    nulls and end the order.
    """
    narrow = df.select(*dict.fromkeys([*columns, *key])).repartitionByRange(*order)
    ranged = written(narrow.withColumn("_range", F.spark_partition_id()), "ranges")
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # one row per range
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", "_n", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    held = counts.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).select("_range", "_before")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    wanted = ranged.join(held, "_range").withColumn("_place", place).where(f"_place > {offset} AND _place <= {offset + limit}")
    return df.join(wanted.select(*key, "_place"), key).orderBy("_place").drop("_place")


def product_page(products: DataFrame, sort: str = DEFAULT_SORT, limit: int = DEFAULT_LIMIT, offset: int = 0,
                 category_id: str | None = None, available: bool | None = None) -> DataFrame:
    check_page(limit, offset, sort)
    rows = keep_available(in_category(products, category_id), available)
    return list_item(page(rows, [PRODUCT_SORTS[sort](), F.col("id")], limit, offset))


def product_page_sorted_by(products: DataFrame, column: str, ascending: bool = True, limit: int = DEFAULT_LIMIT,
                           offset: int = 0, available: bool | None = True) -> DataFrame:
    """Free sort column; nulls stand last when ascending and first when descending."""
    if column not in ("title", "price", "created_at"):
        raise ValueError(f"sort column: {column}")
    first = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_first()
    return list_item(page(keep_available(products, available), [first, F.col("id")], limit, offset))


def with_total(page_rows: DataFrame, filtered: DataFrame) -> DataFrame:
    """Add the exact number of rows behind a page, as a scalar subquery."""
    return page_rows.withColumn("total", filtered.agg(F.count(F.lit(1))).scalar())


def page_meta(filtered: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One row: total, page, limit, total_pages, has_next, has_prev."""
    check_page(limit, offset)
    current = offset // limit + 1
    return (filtered.agg(F.count(F.lit(1)).alias("total"))
            .withColumn("page", F.lit(current).cast("bigint"))
            .withColumn("limit", F.lit(limit).cast("bigint"))
            .withColumn("total_pages", F.ceil(F.col("total") / limit).cast("bigint"))
            .withColumn("has_next", F.lit(current) < F.col("total_pages"))
            .withColumn("has_prev", F.lit(current > 1)))


def keyset_page(df: DataFrame, last: object, limit: int = DEFAULT_LIMIT, key: str = "id") -> DataFrame:
    """Next page after a key: the filter prunes the scan, where a deep offset would sort it all."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(limit)


def product_detail(products: DataFrame, categories: DataFrame, product_id: str) -> DataFrame:
    """One product with its category (null when it has none) and defaults for empty fields."""
    wanted = by_key(products, product_id)
    named = categories.select(F.col("id").alias("category_id"), F.col("title").alias("category_title"))
    return wanted.join(named, "category_id", "left").withColumns({
        "image_urls": F.coalesce("image_urls", F.array().cast("array<string>")),
        "specs": F.coalesce("specs", F.create_map().cast("map<string,string>"))})


def search_title(products: DataFrame, query: str, category_id: str | None = None) -> DataFrame:
    """Substring search in any case; % and _ in the query act as wildcards."""
    return keep_available(in_category(products, category_id)).filter(F.col("title").ilike(f"%{query}%"))


def search_ranked(products: DataFrame, query: str) -> DataFrame:
    """Rows whose title has every query word; rank is the share of title words that are query words."""
    terms = [t for t in re.split(r"\W+", query.lower()) if t]
    words = F.filter(F.split(F.lower("title"), r"\W+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(terms)))
    every = F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(words, t))
    return (keep_available(products).filter(every)
            .withColumn("rank", F.round(hits / F.size(words), 6)))


def spec_equals(products: DataFrame, key: str, value: str) -> DataFrame:
    return products.filter(F.element_at("specs", F.lit(key)) == value)


def spec_has_key(products: DataFrame, key: str) -> DataFrame:
    return products.filter(F.map_contains_key("specs", key))


def spec_contains(products: DataFrame, wanted: dict[str, str]) -> DataFrame:
    for key, value in wanted.items():
        products = spec_equals(products, key, value)
    return products


def spec_text_contains(products: DataFrame, text: str) -> DataFrame:
    return products.filter(F.to_json("specs").contains(text))


def clean_specs(specs: Column) -> Column:
    return F.map_filter(specs, lambda k, v: v.isNotNull() & (v != ""))


BOOK_SPECS = {"author": "string", "isbn": "string", "publisher": "string", "pages": "int", "language": "string",
              "format": "string", "publication_date": "string", "dimensions": "string", "weight": "string"}


def typed_specs(specs: Column) -> dict[str, Column]:
    """Typed columns of a specs document given as JSON text, VARIANT or map; a bad type gives null."""
    return {name: F.try_variant_get(specs, f"$.{name}", kind) for name, kind in BOOK_SPECS.items()}


def purge_prefix(df: DataFrame, prefix_pattern: str, column: str = "source_url") -> DataFrame:
    """Rows left after the delete; a null value matches no pattern and stays."""
    return df.filter(~F.coalesce(F.col(column).like(prefix_pattern), F.lit(False)))


def categories_with_navigation(categories: DataFrame, navigation: DataFrame) -> DataFrame:
    nav = navigation.select(F.col("id").alias("navigation_id"), F.col("title").alias("navigation_title"),
                            F.col("parent_id").alias("navigation_parent_id"))
    return categories.join(nav, "navigation_id", "left")


def categories_under(categories: DataFrame, navigation: DataFrame, parent_id: str) -> DataFrame:
    children = navigation.filter(F.col("parent_id") == parent_id).select(F.col("id").alias("navigation_id"))
    return categories.join(children, "navigation_id", "left_semi")


def products_of_category(products: DataFrame, categories: DataFrame, category_id: str) -> DataFrame:
    named = categories.filter(F.col("id") == category_id).select(
        F.col("id").alias("category_id"), F.col("title").alias("category_title"))
    return keep_available(in_category(products, category_id)).join(named, "category_id")


def active_products(products: DataFrame, categories: DataFrame, navigation: DataFrame, as_of: Column,
                    days: int = 30) -> DataFrame:
    named = categories.select(F.col("id").alias("category_id"), F.col("title").alias("category_title"), "navigation_id")
    placed = navigation.select(F.col("id").alias("navigation_id"), F.col("title").alias("navigation_title"))
    recent = F.col("last_scraped_at") > as_of - F.make_dt_interval(days=F.lit(days))
    return keep_available(products).filter(recent).join(named.join(placed, "navigation_id"), "category_id")


def dangling_count(children: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Rows whose key is set but has no parent row.  Counted per key first, so a hot key is one row."""
    per_key = children.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("n"))
    lost = per_key.join(parents.select(F.col("id").alias("_key")), "_key", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dangling"))


def orphans(children: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Rows with no parent row, null keys included."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_anti")


"""Readers: stored tables, pages, payloads, logs, access logs, seed rows, generated products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas as S


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A stored table; naming the schema spares the footer read of every file."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as page_id, url, html: a Parquet table, or one text file per page named by its path."""
    if path.endswith((".html", ".htm")):
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.xxhash64(F.input_file_name()).alias("page_id"),
                            F.input_file_name().alias("url"), F.col("value").alias("html"))
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ANALYTICS_PAYLOAD).json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.LOG).json(path)


def read_http_access(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HTTP_ACCESS).json(path)


def json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def json_field(text: Column, path: str, kind: str) -> Column:
    """Typed value of a JSON text; a missing path, a bad type or bad JSON gives null."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def synthetic_products(ids: DataFrame, site: str) -> DataFrame:
    """One made-up product per value of `id` (counted from 0), e.g. spark.range(n).

    What varies is a hash of the id, so a repeated task makes the same row.
    """
    i = F.col("id")
    pick = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))
    text = (i + 1).cast("string")
    specs = F.create_map(
        F.lit("author"), F.concat(F.lit("Test Author "), (F.floor(i / 10) + 1).cast("string")),
        F.lit("isbn"), F.concat(F.lit("978"), F.lpad(i.cast("string"), 10, "0")),
        F.lit("publisher"), F.lit("Test Publisher"), F.lit("pages"), (pick("pages", 500) + 100).cast("string"),
        F.lit("language"), F.lit("English"),
        F.lit("format"), F.when(i % 2 == 0, "Paperback").otherwise("Hardcover"))
    return ids.select(
        F.concat(F.lit("Test Book "), text).alias("title"),
        F.concat(F.lit(f"{site}/test-book-"), text).alias("source_url"), F.concat(F.lit("test-"), text).alias("source_id"),
        ((pick("price", 5001) + 500) / 100).cast("decimal(10,2)").alias("price"), F.lit("GBP").alias("currency"),
        F.array(F.concat(F.lit(f"{site}/images/test-book-"), text, F.lit(".jpg"))).alias("image_urls"),
        F.concat(F.lit("This is test book number "), text).alias("summary"), specs.alias("specs"),
        (pick("available", 10) > 0).alias("available"),
        F.concat(F.lit("cat-"), (i % 5 + 1).cast("string")).alias("category_id"))

"""Token counts with a cache of digests: only distinct texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import PieceCounter, encoder

CACHE = "digest binary, tokenizer binary, n_tokens long"


def normalised(text: Column) -> Column:
    """What is encoded: the text as it is, a null as the empty text.  Anything more could change a count."""
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def tokenizer_version(path: str, library: str) -> bytes:
    """Digest of the vocabulary file and of the library that applies it."""
    import importlib.metadata

    with open(path, "rb") as file:
        own = hashlib.sha256(file.read())
    own.update(f"{library} {importlib.metadata.version(library)}".encode())
    return own.digest()


def read_cache(spark: SparkSession, cache_path: str, version: bytes) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a row that a repeated job wrote twice counts once."""
    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == F.lit(version))
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit added, by a sentencepiece model.

    1. Each distinct text travels once to the partition of its digest; copies are merged before the shuffle.
    2. Digests that the cache has for this tokenizer version are dropped there; the others are encoded whole and their
       counts appended to the cache at `cache_path`, a folder on shared storage.
    3. The rows, without texts, meet the counts by digest.  A digest with very many rows is split by the skew join.

    A null text counts as the empty text: 0 bytes, 0 tokens.  Repeated rows give repeated rows.  Columns of `docs`
    other than the text are kept; those named n_bytes, n_tokens or over_limit are replaced.  An empty table gives none.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model_path, "sentencepiece")
    # An empty append makes the folder where this is the first run.
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(cache_path)

    distinct = docs.select(content_digest(F.col(text)).alias("digest"), normalised(F.col(text)).alias("_text")) \
        .groupBy("digest").agg(F.first("_text").alias("_text"))
    misses = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = encoder(PieceCounter, model_path)
        for batch in batches:
            counts = [model.count(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([version] * len(counts), pa.binary()), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*[c for c in kept], F.octet_length(normalised(F.col(text))).cast("long").alias("n_bytes"),
                       content_digest(F.col(text)).alias("__digest"))
    counts = read_cache(spark, cache_path, version).select(F.col("digest").alias("__counted"), "n_tokens")
    return (rows.join(counts, F.col("__digest") == F.col("__counted"))
            .withColumn("over_limit", F.col("n_tokens") > limit).drop("__digest", "__counted"))

"""Full-text search of titles over an inverted index: stems with their places, ranked by how near they stand.

The index is written once, sorted by term, so a search reads only the parts of the files whose range holds its terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stem import STOP_WORDS, stems_sql, words_sql
from ..session import spread, written

ROW_GROUP = 1 << 20      # bytes of an index file that are read or skipped together
POSTINGS = "term string, id string, positions array<int>"


def postings(rows: DataFrame, text: str = "title", key: str = "id") -> DataFrame:
    """term, key, positions (from 1, stop words counted) for each different stem of a text.  No shuffle."""
    worded = rows.select(key, F.expr(words_sql(f"`{text}`")).alias("_words")).withColumn("_stems", F.expr(stems_sql("_words")))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    placed = F.expr("filter(transform(_words, (w, i) -> struct(_stems[i] AS term, CAST(i + 1 AS INT) AS at, w AS word)), "
                    f"x -> x.word NOT IN ({stop}))")
    return worded.withColumn("_placed", placed).select(key, F.expr(
        "inline(transform(array_distinct(transform(_placed, x -> x.term)), "
        "t -> struct(t AS term, transform(filter(_placed, x -> x.term = t), x -> x.at) AS positions)))")).select("term", key, "positions")


def write_index(rows: DataFrame, path: str, text: str = "title", key: str = "id") -> None:
    """Write the postings sorted by term; those of a frequent term may cover several files."""
    # Stemming costs more than its bytes tell, and the range sort reads its rows twice.
    found = written(postings(spread(rows.select(key, text), key), text, key), "postings")
    (found.repartitionByRange("term", key).sortWithinPartitions("term", key)
     .write.option("parquet.block.size", ROW_GROUP).parquet(path))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The different stems of a query, without stop words."""
    made = postings(spark.createDataFrame([("q", query)], "id string, title string"))
    return sorted(r.term for r in made.select("term").collect())


def _rank(hits: Column, terms: int) -> Column:
    """PostgreSQL's ts_rank with its default weight of 0.1, of hits array<struct<term, positions>>.

    One term: the sum of 0.1 / place^2 over its occurrences, as a share of pi^2 / 6.  Several: each pair of occurrences of
    two terms adds 0.1 * sqrt(nearness of their distance), put together as chances.
    """
    if terms == 1:
        found = F.get(hits, F.lit(0))["positions"]
        return F.aggregate(F.sequence(F.lit(1), F.size(found)), F.lit(0.0), lambda sum_, n: sum_ + F.lit(0.1) / (n * n)) / (math.pi ** 2 / 6)

    def between(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a["positions"], lambda p: F.transform(b["positions"], lambda q: F.abs(p - q))))

    pairs = F.flatten(F.transform(hits, lambda a: F.flatten(F.transform(F.filter(hits, lambda b: b["term"] < a["term"]), lambda b: between(a, b)))))
    near = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    return 1 - F.aggregate(pairs, F.lit(1.0), lambda rest, d: rest * (1 - 0.1 * F.sqrt(near(d))))


def matches(index: DataFrame, terms: list[str], key: str = "id") -> DataFrame:
    """key, rank of what has all terms.  No terms, no rows.  A key has at most one posting of each term."""
    chosen = index.filter(F.col("term").isin(terms)) if terms else index.filter("false")
    hits = chosen.groupBy(key).agg(F.collect_list(F.struct("term", "positions")).alias("_hits")).filter(F.size("_hits") == len(terms))
    return hits.select(key, F.round(_rank(F.col("_hits"), len(terms)), 6).alias("rank"))


def search(products: DataFrame, index_path: str, query: str) -> DataFrame:
    """Available products whose title has all words of the query in some form, with their rank."""
    spark = products.sparkSession
    found = matches(spark.read.schema(POSTINGS).parquet(index_path), query_terms(spark, query))
    return products.filter("available").join(found, "id")

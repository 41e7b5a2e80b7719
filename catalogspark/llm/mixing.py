"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .common import running_total, word_count

WEIGHTS = (3, 1, 2)


def source_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: source, rank, weight, source_size, before (size of earlier sources), target, budget.

    Sources in code-point order, null last, take the weights in turn.  Together they share `share` times all sizes; a
    target stops at `repeats` times its source's size and the rest is shared again.  All targets stand at the same
    virtual time: target = least(weight * time, repeats * size).  The time is found by letting sources reach their stop
    in the order in which they do, so it takes one sorted pass over the table of sources, which is as long as the list
    of weights, not as the data.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = (one.withColumn("rank", F.row_number().over(by_name) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                 (F.col("rank") % len(weights) + 1).cast("int")))
              .withColumn("stop", F.lit(float(repeats)) * F.col("source_size"))
              .withColumn("before", F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
                          - F.col("source_size"))
              .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    upto = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    levels = (ranked.withColumn("stopped", F.coalesce(F.sum("stop").over(upto), F.lit(0.0)))
              .withColumn("running", F.sum("weight").over(Window.partitionBy())
                          - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
              # The virtual time if just the sources before this one have stopped.
              .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("running")))
    # It is the right one for the first source that does not stop before it; for later ones it only falls.  Where all
    # stop, no time is too late.
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.col("level"))
    time = F.coalesce(F.max(fits).over(Window.partitionBy()), F.lit(float("inf")))
    return levels.withColumn("target", F.least(F.col("weight") * time, F.col("stop"))).select(
        "source", "rank", "weight", "source_size", "before", "target", "budget")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """How often the mix takes each document: doc_id, source, digest, size, copies, source_size, target, times.

    Rows alike in id, source and text are one entry with `copies` rows, taken together.  The documents of a source stand
    in a queue, shuffled by a digest of their id; the queue is gone through `repeats` times.  A document's virtual
    finish time is the words of its source up to its end, divided by the source's weight.  All entries are range-sorted
    by finish time and taken until the next one would pass the total budget.  Both running totals come from one
    range sort each (`running_total`), so a source with any share of the rows is spread over many tasks.

    A null text has size 0, a null source is a source of its own, a null id is an id like others.  Reruns agree.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    sizes = written(
        docs.select("doc_id", "source", digest.alias("digest"), word_count(F.col("text")).alias("_words"))
        .groupBy("doc_id", "source", "digest", F.col("_words").alias("words"))
        .agg(F.count("*").alias("copies")).withColumn("size", F.col("words") * F.col("copies"))
        .withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), "sizes")
    plan = written(source_plan(sizes, weights, share, repeats), "sources")

    queued = sizes.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    queue = written(
        running_total(queued.drop("_source"), ["rank", "turn", "doc_id", "digest"], "size", "upto")
        .withColumn("finish", (F.col("upto") - F.col("before")) / F.col("weight")), "queue")

    def entry(turn):
        return F.struct((F.col("finish") + turn * F.col("source_size") / F.col("weight")).alias("at"), F.col("rank"),
                        F.lit(turn).alias("pass"), F.col("turn"), F.col("doc_id"), F.col("digest"))

    entries = (queue.select("size", "budget", F.explode(F.array(*[entry(n) for n in range(repeats)])).alias("e"))
               .select("size", "budget", "e.*"))
    order = ["at", "rank", "pass", "turn", "doc_id", "digest"]
    served = running_total(entries, order, "size", "served")
    last = served.where(F.col("served") <= F.col("budget")).agg(F.max(F.struct(*order)).alias("last"))
    # The cut is one row; it is attached as a scalar subquery.
    end = last.scalar() if hasattr(last, "scalar") else F.lit(last.first()[0])
    times = sum((F.when(entry(n) <= end, 1).otherwise(0) for n in range(1, repeats)), F.when(entry(0) <= end, 1).otherwise(0))
    return queue.select("doc_id", "source", "digest", F.col("words").alias("size"), "copies", "source_size", "target",
                        times.alias("times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, columns as in `docs`: documents not taken are gone, those taken twice are there twice.

    Documents without words have no weight in a mix and are kept once.
    """
    plan = mix_plan(docs, **options).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"),
        F.when(F.col("size") == 0, 1).otherwise(F.col("times")).alias("__times")).where("__times > 0")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
                      & (own == F.col("__digest")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*[F.col(f"`{c}`") for c in docs.columns])

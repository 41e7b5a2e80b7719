"""Structured Streaming jobs.  State is kept by Spark: in aggregations here, by key and with timers in `keyed`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schemas as S
from ..operators import jobs as J, merge as M
from ..operators.validate import within_tolerance
from ..session import scratch_path, written
from ..sources.exports import BucketedTable
from .keyed import PROVIDER

TOLERANCE = "5 minutes"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 64,
                names: str | None = None) -> DataFrame:
    """The files of a folder as a stream; `names` is a pattern that their names must match."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt)
    return (reader.option("pathGlobFilter", names) if names else reader).load(path)


def start_keyed(stream: DataFrame, out: str) -> StreamingQuery:
    """Start a stream with per-key state (`keyed`) into a Parquet sink; its state store is one that has timers."""
    conf, (name, provider) = stream.sparkSession.conf, PROVIDER
    before = conf.get(name)
    conf.set(name, provider)
    try:  # the setting is read when a stream starts, and other streams keep theirs
        return (stream.writeStream.format("parquet").option("path", f"{out}/data")
                .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    finally:
        conf.set(name, before)


def drain(stream: DataFrame, purpose: str, keyed: bool = False) -> DataFrame:
    """Append everything that is there now to a Parquet sink and read it back."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, purpose)
    if keyed:
        query = start_keyed(stream, out)
    else:
        query = (stream.writeStream.format("parquet").option("path", f"{out}/data")
                 .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_updates(stream: DataFrame, purpose: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregation over everything there now; the last value of each key.

    Each micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, purpose)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/data/b={batch_id}")

    save(spark.createDataFrame([], stream.schema), -1)  # so that a stream without rows gives an empty frame
    query = (stream.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    updates = spark.read.parquet(f"{out}/data/*")
    rest = [c for c in updates.columns if c not in keys and c != "_batch"]
    return (updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


def deduplicated(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Clickstream ingest: an event id counts once within the tolerated delay."""
    return events.withWatermark(ts, TOLERANCE).dropDuplicatesWithinWatermark([key])


def log_tail(logs: DataFrame, level: str | None = None, component: str | None = None) -> DataFrame:
    if level is not None:
        logs = logs.filter(F.col("level") == level)
    return logs if component is None else logs.filter(F.col("component") == component)


def split_late(events: DataFrame, received: str, sent: str, window_ms: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Rows received within the tolerance, and the side output of the others, rows without a time among them."""
    ok = F.coalesce(within_tolerance(F.unix_millis(received), F.unix_millis(sent), window_ms), F.lit(False))
    return events.filter(ok), events.filter(~ok)


def freshness_transitions(writes: DataFrame, ttl: str, expiry: str, key: str = "key", ts: str = "ts",
                          delay: str = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """When keys turn fresh and stale, and when they expire, from the stream of their cache writes.

    A key is fresh while writes come no further apart than its ttl: a session window.  Its end is the
    moment it turns stale, the end of the session with the longer gap the moment it expires.
    """
    marked = writes.withWatermark(ts, delay)
    fresh = marked.groupBy(key, F.session_window(ts, ttl).alias("w")).agg(F.count(F.lit(1)).alias("writes"))
    usable = marked.groupBy(key, F.session_window(ts, expiry).alias("w")).agg(F.count(F.lit(1)).alias("writes"))
    return (fresh.select(key, F.col("w.start").alias("fresh_at"), F.col("w.end").alias("stale_at"), "writes"),
            usable.select(key, F.col("w.start").alias("fresh_at"), F.col("w.end").alias("expired_at"), "writes"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions by gap.  Add a watermark to use it on a stream."""
    window = F.session_window(ts, gap).alias("w")
    return events.groupBy(key, window).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_at")).select(
        key, F.col("w.start").alias("start_at"), "last_at", "events")


def sessions_by_id(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


def fold_jobs(events: DataFrame) -> DataFrame:
    """Job state from its events(job_id, ts, seq, kind, worker, error, max_attempts).  Batch and streaming.

    Kinds: enqueue, claim, complete, fail.  The state is what the last event says, the attempts are
    the claims so far, and a failure goes back to the queue while attempts are left.  All of this is
    aggregation, so events may come in any order and combine before the shuffle.
    """
    at = F.struct("ts", "seq")
    last = lambda c: F.max_by(c, at)
    folded = events.groupBy("job_id").agg(
        last("kind").alias("_kind"), last("worker").alias("_worker"), F.max("ts").alias("updated_at"),
        F.min("ts").alias("created_at"), F.count_if(F.col("kind") == "claim").cast("int").alias("attempts"),
        F.max("max_attempts").alias("max_attempts"),
        F.max_by("error", F.when(F.col("kind") == "fail", at)).alias("last_error"))
    kind, left = F.col("_kind"), F.col("attempts") < F.col("max_attempts")
    status = (F.when(kind == "claim", "running").when(kind == "complete", "completed")
              .when((kind == "fail") & ~left, "failed").otherwise("queued"))
    running = status == "running"
    return folded.select(
        "job_id", status.alias("status"), "attempts", "max_attempts", "last_error", "created_at", "updated_at",
        F.when(running, F.col("updated_at")).alias("locked_at"), F.when(running, F.col("_worker")).alias("locked_by"),
        F.when(status.isin(S.TERMINAL_STATUSES), F.col("updated_at")).alias("completed_at"))


def folded_at(folded: DataFrame, as_of: Column, lock_minutes: int = J.LOCK_MINUTES) -> DataFrame:
    """The folded state at a moment: locks older than their time to live are back in the queue."""
    return J.recover_expired(folded, as_of, lock_minutes).drop("released")


def live_counts(feed: DataFrame) -> DataFrame:
    """Running change of the product count per category, from a product change feed."""
    return M.signed_changes(feed).groupBy("category_id").agg(F.sum("delta").alias("delta"))


def upsert_stream(stream: DataFrame, store: BucketedTable, table: str, as_of: Column, order: list[str],
                  mode: str = "overwrite", keep: int = 2) -> None:
    """Merge each micro-batch into the buckets that its rows fall into, under the batch's number.

    What is written follows the batch, not the table.  A repeated batch reads the layout before its own and replaces its own
    folder, so it changes nothing.  Buckets that the last `keep` layouts do not name are removed.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch.filter(F.col(store.key).isNotNull()), "upsert-batch")
        store.merge(rows, batch_id + 1, lambda current, new: M.upsert(current, new, table, as_of, order, mode).drop("action"))
        store.expire(keep)

    query = (stream.writeStream.foreachBatch(merge)
             .option("checkpointLocation", scratch_path(stream.sparkSession, "upsert-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


class Progress(StreamingQueryListener):
    """Calls a user's function with the input rows and state rows of every finished micro-batch."""

    def __init__(self, on_batch: Callable[[int, int, int], None]) -> None:
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.on_batch(progress.batchId, progress.numInputRows, sum(s.numRowsTotal for s in progress.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

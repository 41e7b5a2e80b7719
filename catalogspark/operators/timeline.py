"""Ordered computations per key that stay parallel when one key holds most of the rows.

The time axis is cut into buckets.  Rows of one (key, bucket) are a bounded piece of time, and what
crosses a bucket border is carried by a table with one row per (key, bucket), made by a partial
aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sliding_counts(requests: DataFrame, key: str, ts_ms: str, windows_ms: dict[str, int]) -> DataFrame:
    """Per (key, instant): requests at it (`n`) and, for each named window w, those in (t - w, t].

    A request counts from its instant on and no more from w later, so a window's count is a running total of what begins
    and ends: the cost is linear, however many instants a window holds.
    """
    bucket_ms = max(windows_ms.values())
    instants = requests.groupBy(key, ts_ms).agg(F.count(F.lit(1)).alias("n"))
    change = lambda at, own, **deltas: F.struct(
        at.alias("_at"), F.lit(own).alias("_own"), *[deltas.get(w, F.lit(0).cast("bigint")).alias(f"_{w}") for w in windows_ms])
    n, at = F.col("n"), F.col(ts_ms)
    changes = F.array(change(at, True, **dict.fromkeys(windows_ms, n)),
                      *[change(at + w, False, **{name: -n}) for name, w in windows_ms.items()])
    # Each instant also visits the next bucket, where it only serves as the past of other rows.
    bucket = F.floor(at / bucket_ms)
    spread = (instants.select(key, "n", bucket.alias("_home"), F.explode(F.sequence(bucket, bucket + 1)).alias("_bucket"), changes.alias("_changes"))
              .select(key, "n", "_home", "_bucket", F.inline("_changes"))
              .filter(F.floor(F.col("_at") / bucket_ms) <= F.col("_bucket")))
    so_far = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    counts = {name: F.sum(f"_{name}").over(so_far) for name in windows_ms}
    return (spread.withColumns(counts).filter(F.col("_own") & (F.col("_home") == F.col("_bucket")))
            .select(key, F.col("_at").alias(ts_ms), "n", *windows_ms))


def running_totals(df: DataFrame, key: str, order: list[str], bucket: Column, value: str) -> DataFrame:
    """Add `running_sum` and `running_count` of a value in the order of the key's rows.

    `bucket` must not decrease along `order`.
    """
    rows = df.withColumn("_bucket", bucket)
    per_bucket = rows.groupBy(key, "_bucket").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        key, "_bucket", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(offsets, [key, "_bucket"])
            .withColumn("running_sum", F.col("_s0") + F.sum(value).over(inside))
            .withColumn("running_count", F.col("_n0") + F.count(value).over(inside))
            .drop("_s0", "_n0", "_bucket"))


def gap_sessions(events: DataFrame, key: str, ts_ms: str, gap_ms: int) -> DataFrame:
    """Sessions per key split where nothing happens for at least `gap_ms`.

    Events of one gap-long bucket can never be a gap apart, so one row per (key, bucket) with its
    first and last instant is enough to find every session border.
    """
    buckets = events.groupBy(key, F.floor(F.col(ts_ms) / gap_ms).alias("_bucket")).agg(
        F.min(ts_ms).alias("_first"), F.max(ts_ms).alias("_last"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(key).orderBy("_bucket")
    starts = F.coalesce((F.col("_first") - F.lag("_last").over(along) >= gap_ms).cast("int"), F.lit(1))
    return (buckets.withColumn("_start", starts)
            .withColumn("session_no", F.sum("_start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(key, "session_no")
            .agg(F.min("_first").alias("start_ms"), F.max("_last").alias("end_ms"), F.sum("_n").alias("events")))


def with_next(df: DataFrame, key: str, ts: str, bucket: Column, name: str) -> DataFrame:
    """Add the next later value of `ts` of the same key (null for the last row)."""
    rows = df.withColumn("_bucket", bucket)
    heads = rows.groupBy(key, "_bucket").agg(F.min(ts).alias("_head"))
    following = heads.select(
        key, "_bucket", F.lead("_head").over(Window.partitionBy(key).orderBy("_bucket")).alias("_next_head"))
    inside = Window.partitionBy(key, "_bucket").orderBy(ts)
    return (rows.join(following, [key, "_bucket"])
            .withColumn(name, F.coalesce(F.lead(ts).over(inside), F.col("_next_head")))
            .drop("_bucket", "_next_head"))

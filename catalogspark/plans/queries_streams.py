"""Streaming queries.  Each drains the given table as a stream; the SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics as X
from ..session import prepare, scratch_path
from ..sources import adapters as A
from ..sources.exports import BucketedTable
from ..streaming import keyed as K, streams as T
from .queries_catalog import _SIGNED, _SCRAPED, change_feed
from .queries_jobs import _stamp, _stamp_sql
from .registry import ORACLES, query
from .views_sql import SITE, with_views


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A stream source wants a folder; the table may be one, or one file in the folder of all tables.
    path = f"{sf}/{name}.parquet"
    table = spark.read.parquet(path)
    one_file = all(file.endswith(f"/{name}.parquet") for file in table.inputFiles())
    folder, names = (sf, f"{name}.parquet") if one_file else (path, None)
    return T.read_stream(prepare(spark), folder, table.schema, names=names)


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    return stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_events", "SELECT event_id, event_type, user_id FROM events")
def stream_ingest(spark, sf):
    """Every event sent twice and kept once."""
    twice = stream_events(spark, sf).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    return T.drain(T.deduplicated(twice, "event_id"), "clicks").select("event_id", "event_type", "user_id")


@query("stream_log_tail", with_views(
    "SELECT event_id, level, component FROM log WHERE level = 'error' AND component = 'queue'", "log"))
def stream_log_tail(spark, sf):
    kind, u = F.col("event_type"), F.col("user_id")
    logs = stream_events(spark, sf).select(
        "event_id", F.when(kind == "error", "error").when(kind == "signup", "warn").otherwise("info").alias("level"),
        F.element_at(F.array(*[F.lit(c) for c in X.COMPONENTS]), (u % 5 + 1).cast("int")).alias("component"))
    return T.drain(T.log_tail(logs, "error", "queue"), "log-tail")


@query("stream_late", """SELECT event_id % 11 > 5 OR event_id % 13 = 0 AS late, count(*) AS n FROM events GROUP BY 1""")
def stream_late(spark, sf):
    """Events received up to ten minutes after they happened, some without a time, split at the tolerance of five."""
    received = stream_events(spark, sf).withColumn(
        "received", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 11).cast("int"))).withColumn(
        "ts", F.when(F.col("event_id") % 13 != 0, F.col("ts")))
    on_time, late = T.split_late(received, "received", "ts")
    rows = T.drain(on_time, "on-time").withColumn("late", F.lit(False)).unionByName(
        T.drain(late, "late").withColumn("late", F.lit(True)))
    return rows.groupBy("late").agg(F.count(F.lit(1)).alias("n"))


def _gap_sql(gap_us: int) -> str:
    return f"""SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS writes FROM (
        SELECT *, sum(CASE WHEN us - previous < {gap_us} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no
        FROM (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events))
      GROUP BY user_id, no"""


# A window is final once the watermark (the last event less five minutes) has passed its end.
@query("stream_freshness", with_views(
    """SELECT 'stale' AS turn, user_id, first_us AS fresh_us, last_us + 3600000000 AS at_us, writes FROM hour, mark WHERE last_us + 3600000000 <= us
    UNION ALL SELECT 'expired', user_id, first_us, last_us + 10800000000, writes FROM three, mark WHERE last_us + 10800000000 <= us""",
    hour=_gap_sql(3_600_000_000), three=_gap_sql(10_800_000_000),
    mark="SELECT (max(epoch_us(ts)) // 1000 - 300000) * 1000 AS us FROM events"))
def stream_freshness(spark, sf):
    fresh, usable = T.freshness_transitions(stream_events(spark, sf), "1 hour", "3 hours", key="user_id")
    stale = T.drain(fresh, "stale").withColumnRenamed("stale_at", "at").withColumn("turn", F.lit("stale"))
    expired = T.drain(usable, "expired").withColumnRenamed("expired_at", "at").withColumn("turn", F.lit("expired"))
    return stale.unionByName(expired).select("turn", "user_id", F.unix_micros("fresh_at").alias("fresh_us"),
                                             F.unix_micros("at").alias("at_us"), "writes")


def job_events(orders: DataFrame) -> DataFrame:
    """Job events from the orders: as many claims as attempts, a failure between them, and the order's ending."""
    o, n = F.col("o_orderkey"), (F.col("o_orderkey") % 4).cast("int")
    event = lambda kind, seq: F.struct(F.lit(kind).alias("kind"), seq.cast("int").alias("seq"))
    claims = F.transform(F.sequence(F.lit(1), n), lambda i: event("claim", 2 * i - 1))
    failures = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: event("fail", 2 * i)))
    none = F.slice(F.array(event("x", F.lit(0))), 1, 0)
    ending = (F.when((n == 0) | (F.col("o_orderstatus") == "P"), none)
              .when((F.col("o_orderstatus") == "F") & (o % 5 != 0), F.array(event("complete", 2 * n)))
              .otherwise(F.array(event("fail", 2 * n))))
    timeline = F.concat(F.array(event("enqueue", F.lit(0))), F.when(n > 0, claims).otherwise(none),
                        F.coalesce(failures, none), ending)
    rows = orders.select("o_orderkey", "o_custkey", "o_orderdate", F.inline(timeline))
    return rows.select(
        F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job_id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=F.col("seq"))).alias("ts"), "seq", "kind",
        F.concat(F.lit("worker-"), (F.col("o_custkey") % 8).cast("string")).alias("worker"),
        F.when(F.col("kind") == "fail", F.concat(F.lit("error "), F.col("seq").cast("string"))).alias("error"),
        F.lit(3).alias("max_attempts"))


_FOLD = f"""SELECT 'j' || o AS job_id, CASE WHEN n = 0 THEN 'queued' WHEN s = 'P' THEN 'running' WHEN s = 'F' AND o % 5 <> 0 THEN 'completed'
    WHEN n < 3 THEN 'queued' ELSE 'failed' END AS status, CAST(n AS INTEGER) AS attempts,
  CASE WHEN n = 0 THEN NULL WHEN s = 'P' OR (s = 'F' AND o % 5 <> 0) THEN CASE WHEN n > 1 THEN 'error ' || (2 * n - 2) END ELSE 'error ' || (2 * n) END AS last_error,
  CASE WHEN n > 0 AND s = 'P' THEN 'worker-' || (c % 8) END AS locked_by,
  CASE WHEN n > 0 AND ((s = 'F' AND o % 5 <> 0) OR (s <> 'P' AND n = 3)) THEN {_stamp_sql('d + to_minutes(CAST(2 * n AS INTEGER))', 'x')[:-5]} END AS completed_at
  FROM (SELECT o_orderkey AS o, o_orderkey % 4 AS n, o_orderstatus AS s, o_custkey AS c, o_orderdate AS d FROM orders)"""


def _fold_columns(folded: DataFrame) -> DataFrame:
    return folded.select("job_id", "status", "attempts", "last_error", "locked_by", _stamp("completed_at"))


@query("job_fold", _FOLD)
def job_fold(spark, sf):
    return _fold_columns(T.fold_jobs(job_events(A.table(spark, sf, "orders"))))


@query("stream_job_fold", _FOLD)
def stream_job_fold(spark, sf):
    return _fold_columns(T.drain_updates(T.fold_jobs(job_events(stream_table(spark, sf, "orders"))), "job-fold", ["job_id"]))


# The watermark at the end: the last event of all less five minutes.
@query("stream_job_locks", f"""SELECT status, cause, count(*) AS n FROM (
  SELECT CASE WHEN status = 'running' AND expired THEN 'queued' ELSE status END AS status,
    CASE WHEN status = 'running' AND expired THEN 'lock expired' WHEN attempts = 0 THEN 'enqueue' WHEN status = 'running' THEN 'claim'
      WHEN status = 'completed' THEN 'complete' ELSE 'fail' END AS cause
  FROM (SELECT f.status, f.attempts, o.o_orderdate + to_minutes(CAST(2 * f.attempts - 1 + 10 AS INTEGER)) <=
          (SELECT max(o_orderdate + to_minutes(CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderstatus = 'P' THEN 2 * (o_orderkey % 4) - 1
            ELSE 2 * (o_orderkey % 4) END AS INTEGER))) - INTERVAL 5 MINUTE FROM orders) AS expired
        FROM ({_FOLD}) f JOIN orders o ON f.job_id = 'j' || o.o_orderkey)) GROUP BY status, cause""")
def stream_job_locks(spark, sf):
    """Jobs as their stream leaves them: timers have put those whose locks outlived their time back into the queue."""
    states = T.drain(K.job_states(job_events(stream_table(spark, sf, "orders"))), "job-locks", keyed=True)
    return K.newest_states(states).groupBy("status", "cause").agg(F.count(F.lit(1)).alias("n"))


@query("stream_counts", with_views(
    "SELECT category_id, CAST(sum(delta) AS BIGINT) AS delta FROM signed WHERE category_id IS NOT NULL GROUP BY category_id",
    "product", signed=_SIGNED))
def stream_counts(spark, sf):
    k = F.col("p_partkey")
    products = stream_table(spark, sf, "part").select(
        k.cast("string").alias("id"),
        F.when(k % 23 == 0, None).when(k % 29 == 0, "Brand#404").otherwise(F.col("p_brand")).alias("category_id"))
    return T.drain_updates(T.live_counts(change_feed(products)), "counts", ["category_id"])


@query("stream_upsert", with_views(
    """SELECT source_url, coalesce(s.title, p.title) AS title, CAST(coalesce(s.price, p.price) AS DOUBLE) AS price
    FROM product p FULL OUTER JOIN scraped s USING (source_url)""", "product", scraped=_SCRAPED))
def stream_upsert(spark, sf):
    """Scraped rows as a stream, merged batch by batch into the buckets that they touch."""
    products = A.product(spark, sf)
    store = BucketedTable(spark, scratch_path(spark, "product-store"), products.schema, buckets=16)
    store.replace(products, list(range(16)), 0)
    k = F.col("p_partkey")
    number = F.when(k % 9 == 0, k + 100_000_000).otherwise(k)
    scraped = stream_table(spark, sf, "part").filter(k % 3 != 2).withColumn(
        "round", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(F.lit(f"{SITE}/products/"), number.cast("string")).alias("source_url"),
        F.concat(F.col("p_name"), F.lit(" v"), F.col("round").cast("string")).alias("title"),
        F.when(k % 2 == 0, F.col("p_retailprice") + F.col("round")).cast("decimal(10,2)").alias("price"), "round")
    T.upsert_stream(scraped, store, "product", A.as_of(), ["round"])
    return store.read().select("source_url", "title", F.col("price").cast("double").alias("price"))


@query("stream_error_windows", f"""SELECT {_stamp_sql('time_bucket(INTERVAL 5 MINUTE, ts)', 'window_start')}, count(*) AS errors, count(*) > 1 AS alert
  FROM events WHERE event_type = 'error' GROUP BY 1""")
def stream_error_windows(spark, sf):
    logs = stream_events(spark, sf).select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "error").alias("level"))
    rows = T.drain_updates(X.error_windows(logs.withWatermark("timestamp", T.TOLERANCE), threshold=1), "error-windows", ["window_start", "window_end"])
    return rows.select(_stamp("window_start"), "errors", "alert")


@query("stream_sessions", with_views(
    """SELECT session_id, events, start_ms, end_ms FROM (
      SELECT session_id, count(*) AS events, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM clickstream GROUP BY session_id)
    WHERE end_ms + 86400000 <= (SELECT max(epoch_us(ts)) // 1000 - 300000 FROM events)""", "clickstream"))
def stream_sessions(spark, sf):
    """Sessions by the id the client sends, closed a day after the last event."""
    ts = F.col("ts")
    clicks = stream_events(spark, sf).select(
        F.unix_millis(ts).alias("ts_ms"),
        F.concat(F.unix_millis(F.date_trunc("day", ts)).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("session_id"))
    return T.drain(K.sessions_by_id(clicks), "sessions", keyed=True).where("NOT late").drop("late")


@query("stream_sessions_gap", with_views(
    """SELECT user_id, first_us AS start_us, last_us, writes AS events FROM half, mark WHERE last_us + 1800000000 <= us""",
    half=_gap_sql(1_800_000_000), mark="SELECT (max(epoch_us(ts)) // 1000 - 300000) * 1000 AS us FROM events"))
def stream_sessions_gap(spark, sf):
    rows = T.drain(T.sessions(stream_events(spark, sf).withWatermark("ts", T.TOLERANCE), "user_id"), "gap-sessions")
    return rows.select("user_id", F.unix_micros("start_at").alias("start_us"), F.unix_micros("last_at").alias("last_us"), "events")


@query("stream_history", f"""SELECT {_stamp_sql('time_bucket(INTERVAL 1 HOUR, ts)', 'window_start')}, count(*) AS jobs, max(value) AS peak_memory
  FROM events GROUP BY 1""")
def stream_history(spark, sf):
    kind = F.col("event_type")
    samples = stream_events(spark, sf).select(
        "ts", F.lit(1).alias("processed"), (kind != "error").cast("int").alias("succeeded"), (kind == "error").cast("int").alias("failed"),
        F.col("value").alias("memory")).withWatermark("ts", T.TOLERANCE)
    rows = T.drain_updates(X.metrics_history(samples, "1 hour"), "history", ["window_start"])
    return rows.select(_stamp("window_start"), "jobs", "peak_memory")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return stream_events(spark, sf).select(
        F.col("event_type").alias("key"), F.unix_millis("ts").alias("ts_ms"), F.col("event_id").alias("request_id"))


@query("stream_rate_limit", ORACLES["rate_limit_sliding"])
def stream_rate_limit(spark, sf):
    """The sliding-log limit on a stream of requests."""
    return T.drain(K.rate_limit(_requests(spark, sf), 1, 3), "limits", keyed=True).select("key", "request_id", "allowed")


@query("stream_rate_fixed", ORACLES["rate_limit_fixed"])
def stream_rate_fixed(spark, sf):
    """The clock-minute limit on a stream of requests."""
    return T.drain(K.fixed_minute(_requests(spark, sf), limit=2), "minutes", keyed=True).select("key", "request_id", "position", "allowed")

"""Crawl-job queries: plans, outcomes, retries, retention, queue statistics, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import jobs as J, merge as M, ratelimit as R
from ..sources import adapters as A
from ..sources.exports import Snapshots, append_rows
from ..session import scratch_path
from . import ingest, sqlfuncs
from .registry import query
from .views_sql import AS_OF, SITE, with_views

JOBS = "scrape_job"
_STATUSES = ("queued", "running", "completed", "failed")


def jobs_sql(sql: str, **extra: str) -> str:
    return with_views(sql, JOBS, **extra)


def _stamp(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _stamp_sql(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name}"


# ---- statistics ------------------------------------------------------------------------------------------

@query("jobs_by_status", jobs_sql("SELECT status, count(*) AS count FROM scrape_job GROUP BY status"))
def jobs_by_status(spark, sf):
    return J.count_by_status(A.scrape_job(spark, sf))


@query("queue_stats", jobs_sql(
    "SELECT status, count(*) AS count, count(locked_at) AS locked_count FROM scrape_job GROUP BY status"))
def queue_stats(spark, sf):
    return J.queue_stats(A.scrape_job(spark, sf))


@query("queue_totals", jobs_sql(
    f"SELECT {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in _STATUSES)}, count(locked_at) AS locked FROM scrape_job"))
def queue_totals(spark, sf):
    return J.queue_totals(A.scrape_job(spark, sf))


@query("queue_stats_by_type", jobs_sql(
    f"""SELECT status, type, count(*) AS count, round(avg(attempts), 6) AS avg_attempts,
    {_stamp_sql('min(created_at)', 'oldest_job')}, {_stamp_sql('max(created_at)', 'newest_job')}
    FROM scrape_job GROUP BY status, type"""))
def queue_stats_by_type(spark, sf):
    return J.queue_stats_by_type(A.scrape_job(spark, sf)).select(
        "status", "type", "count", F.round("avg_attempts", 6).alias("avg_attempts"), _stamp("oldest_job"), _stamp("newest_job"))


@query("queue_health", jobs_sql(
    f"""SELECT count(*) AS total_jobs, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}_jobs''' for s in _STATUSES)},
      count(locked_at) AS locked_jobs,
      count(*) FILTER (status = 'running' AND locked_at < {AS_OF} - INTERVAL 10 MINUTE) AS expired_locks,
      count(*) FILTER (status = 'failed' AND attempts < max_attempts) AS retryable_jobs,
      CAST(coalesce(epoch({AS_OF}) - epoch(min(created_at) FILTER (status = 'queued')), 0) AS BIGINT) AS oldest_queued_age_s,
      CAST(coalesce(epoch({AS_OF}) - epoch(min(locked_at) FILTER (status = 'running')), 0) AS BIGINT) AS oldest_running_age_s
    FROM scrape_job"""))
def queue_health(spark, sf):
    return J.queue_health(A.scrape_job(spark, sf), A.as_of())


# A moment in the midst of the jobs.
_BUSY_TEXT = "1995-10-15 23:59:59"
_BUSY = f"TIMESTAMP '{_BUSY_TEXT}'"


@query("jobs_last_24h", jobs_sql(
    f"""SELECT completed, failed, coalesce(completed * 100.0 / nullif(completed + failed, 0), CAST(100.0 AS DOUBLE)) AS success_rate
    FROM (SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed
          FROM scrape_job WHERE completed_at >= {_BUSY} - INTERVAL 24 HOUR AND completed_at <= {_BUSY})"""))
def jobs_last_24h(spark, sf):
    return J.recent_outcomes(A.scrape_job(spark, sf), F.lit(_BUSY_TEXT).cast("timestamp"))


# ---- dispatch, locks, retries -------------------------------------------------------------------------------

@query("dispatch_plan", jobs_sql(
    f"""SELECT id, type, priority, attempts + 1 AS attempts, CAST(position AS INTEGER) AS position,
      'w' || ((position - 1) % 3 + 1) AS locked_by
    FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, created_at, id) AS position FROM scrape_job
      WHERE (status = 'running' AND locked_at < {AS_OF} - INTERVAL 10 MINUTE) OR (status = 'queued' AND locked_at IS NULL))
    WHERE position <= 50"""))
def dispatch_plan(spark, sf):
    plan = J.dispatch_plan(A.scrape_job(spark, sf), ["w1", "w2", "w3"], 50, A.as_of())
    return plan.select("id", "type", "priority", "attempts", "position", "locked_by")


def _after_sql(released: str) -> str:
    return jobs_sql(f"""SELECT id, CASE WHEN {released} THEN 'queued' ELSE status END AS status,
      CASE WHEN NOT coalesce({released}, false) THEN locked_by END AS locked_by, coalesce({released}, false) AS released FROM scrape_job""")


@query("expired_locks", _after_sql(f"(status = 'running' AND locked_at < {AS_OF} - INTERVAL 10 MINUTE)"))
def expired_locks(spark, sf):
    rows = J.recover_expired(A.scrape_job(spark, sf), A.as_of())
    return rows.select("id", "status", "locked_by", "released")


@query("stuck_jobs", jobs_sql(
    f"SELECT count(*) AS affected FROM scrape_job WHERE status = 'running' AND locked_at < {AS_OF} - INTERVAL 30 MINUTE"))
def stuck_jobs(spark, sf):
    rows = J.recover_expired(A.scrape_job(spark, sf), A.as_of(), J.STUCK_MINUTES)
    return M.affected(rows.filter("released"))


@query("release_locks", _after_sql("(locked_by = 'worker-3')"))
def release_locks(spark, sf):
    rows = J.release_worker(A.scrape_job(spark, sf), "worker-3", A.as_of())
    return rows.select("id", "status", "locked_by", "released")


@query("retryable", jobs_sql(
    f"""SELECT id, type, target_url, attempts, max_attempts FROM scrape_job WHERE status = 'failed' AND attempts < max_attempts
    AND (last_error IS NULL OR updated_at < {AS_OF} - INTERVAL 5 MINUTE) ORDER BY updated_at, id LIMIT 20"""))
def retryable(spark, sf):
    return J.retryable(A.scrape_job(spark, sf), A.as_of()).select("id", "type", "target_url", "attempts", "max_attempts")


_PICK = "SELECT id FROM scrape_job WHERE status = 'failed' AND attempts < max_attempts ORDER BY updated_at, id LIMIT 100"


@query("requeue", jobs_sql(
    """SELECT id, CASE WHEN id IN (SELECT id FROM picked) THEN 'queued' ELSE status END AS status,
      CASE WHEN id NOT IN (SELECT id FROM picked) THEN last_error END AS last_error FROM scrape_job""", picked=_PICK))
def requeue(spark, sf):
    return J.requeue(A.scrape_job(spark, sf), A.as_of()).select("id", "status", "last_error")


@query("requeue_one", jobs_sql(
    """SELECT id, CASE WHEN id = 'j10' THEN 'queued' ELSE status END AS status, CASE WHEN id <> 'j10' THEN last_error END AS last_error,
      id = 'j10' AS released FROM scrape_job WHERE status = 'failed' AND attempts < max_attempts"""))
def requeue_one(spark, sf):
    """One failed job with attempts left, among the others, which stay as they are."""
    jobs = A.scrape_job(spark, sf)
    failed = jobs.filter("status = 'failed' AND attempts < max_attempts").select("id")
    return J.requeue(jobs, A.as_of(), job_id="j10").join(failed, "id", "left_semi").select("id", "status", "last_error", "released")


def _register_retention(name: str, rule: str, amount: int, where: str, as_of_text: str) -> None:
    moment = f"TIMESTAMP '{as_of_text}'"
    @query(name, jobs_sql(
        f"""SELECT status, count(*) AS kept FROM scrape_job WHERE NOT coalesce({where.format(now=moment)}, false) GROUP BY status"""))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        now = F.lit(as_of_text).cast("timestamp")
        kept = J.apply_retention(A.scrape_job(spark, sf), now, rule, amount)
        return J.count_by_status(kept).withColumnRenamed("count", "kept")


# The job dates span years, so the moment is set inside them.
_register_retention("retention_24h", "terminal_hours", 24,
                    "(status IN ('completed', 'failed') AND completed_at < {now} - INTERVAL 24 HOUR)", "1998-06-01 00:00:00")
_register_retention("retention_7d", "completed_days", 7,
                    "(status = 'completed' AND updated_at < {now} - INTERVAL 7 DAY)", "1998-06-01 00:00:00")
_register_retention("retention_terminal_7d", "terminal_days", 7,
                    "(status IN ('completed', 'failed') AND completed_at < {now} - INTERVAL 7 DAY)", "1998-06-01 00:00:00")


# ---- enqueue, outcomes ----------------------------------------------------------------------------------------

def job_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl requests from the customers (several per target), some for targets without a job."""
    c = F.col("c_custkey")
    target = F.when(c % 7 == 0, c + 10_000_000).otherwise(c)
    kind = F.element_at(F.array(*[F.lit(t) for t in ("navigation", "category", "product")]), (c % 3 + 1).cast("int"))
    rows = A.table(spark, sf, "customer").select(c, target.alias("target"), kind.alias("type"))
    return rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select(
        "type", F.concat(F.lit(f"{SITE}/"), "type", F.lit("/"), F.col("target").cast("string")).alias("target_url"),
        (c % 5 + 2 * F.col("n")).cast("int").alias("priority"),
        F.create_map(F.lit("round"), F.col("n").cast("string")).alias("metadata"), F.col("n").alias("seq"))


_REQUESTS = f"""SELECT c_custkey % 5 + 4 AS asked,
    CASE c_custkey % 3 WHEN 0 THEN 'navigation' WHEN 1 THEN 'category' ELSE 'product' END AS type,
    CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS target FROM customer"""
OPEN_JOBS_SQL = """SELECT type, target_url, min(id) AS id, arg_min(priority, id) AS priority FROM scrape_job
  WHERE status IN ('queued', 'running') GROUP BY type, target_url"""


@query("enqueue_dedup", jobs_sql(
    f"""SELECT q.type, q.url AS target_url, CAST(greatest(q.asked, coalesce(o.priority, 0)) AS INTEGER) AS priority,
      CASE WHEN o.id IS NULL THEN 'insert' ELSE 'raise' END AS action, coalesce(o.id, 'new') AS job, '1' AS round
    FROM (SELECT *, '{SITE}/' || type || '/' || target AS url FROM requests) q
    LEFT JOIN open_jobs o ON o.type = q.type AND o.target_url = q.url""", requests=_REQUESTS, open_jobs=OPEN_JOBS_SQL))
def enqueue_dedup(spark, sf):
    changes = J.enqueue(A.scrape_job(spark, sf), job_requests(spark, sf))
    return changes.select("type", "target_url", "priority", "action",
                          F.when(F.col("action") == "raise", F.col("id")).otherwise("new").alias("job"),
                          F.element_at("metadata", "round").alias("round"))


@query("append_jobs", jobs_sql(
    f"""SELECT status, count(*) AS count, CAST(sum(priority) AS BIGINT) AS priorities FROM (
      SELECT status, CASE WHEN o.id IS NOT NULL THEN greatest(j.priority, q.asked) ELSE j.priority END AS priority
      FROM scrape_job j LEFT JOIN open_jobs o ON o.id = j.id
      LEFT JOIN (SELECT *, '{SITE}/' || type || '/' || target AS url FROM requests) q ON q.type = o.type AND q.url = o.target_url
      UNION ALL SELECT 'queued', asked FROM (SELECT *, '{SITE}/' || type || '/' || target AS url FROM requests) q
      WHERE NOT EXISTS (SELECT 1 FROM open_jobs o WHERE o.type = q.type AND o.target_url = q.url))
    GROUP BY status""", requests=_REQUESTS, open_jobs=OPEN_JOBS_SQL))
def append_jobs(spark, sf):
    jobs = A.scrape_job(spark, sf)
    changes = J.enqueue(jobs, job_requests(spark, sf))
    path = scratch_path(spark, "jobs")
    # The raised jobs are rewritten, the new ones are appended to the same table.
    raised = J.apply_enqueue(jobs, changes.filter("action = 'raise'"), A.as_of())
    append_rows(raised, path)
    append_rows(J.new_jobs(changes.filter("action = 'insert'").drop("action"), A.as_of()).select(*raised.columns), path)
    return spark.read.schema(raised.schema).parquet(path).groupBy("status").agg(
        F.count(F.lit(1)).alias("count"), F.sum("priority").alias("priorities"))


def job_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """An outcome per running job; every 6th comes from a worker that does not own the lock."""
    o = F.col("o")
    running = A.scrape_job(spark, sf).filter("status = 'running'").withColumn("o", F.substring("id", 2, 20).cast("bigint"))
    return running.select(
        "id", F.when(o % 6 == 0, "stranger").otherwise(F.col("locked_by")).alias("worker"), "o",
        (o % 1000).alias("duration"), (o % 40).alias("items"), F.concat(F.lit("network "), o.cast("string")).alias("error"),
        F.create_map(F.lit("customer"), F.lit("none"), F.lit("note"), F.lit("x")).alias("metadata"))


_OWNED = "(status = 'running' AND o % 6 <> 0)"


@query("complete_jobs", jobs_sql(
    f"""SELECT id, CASE WHEN {_OWNED} THEN 'completed' ELSE status END AS status,
      CASE WHEN NOT {_OWNED} THEN locked_by END AS locked_by,
      {_stamp_sql(f'CASE WHEN {_OWNED} THEN {AS_OF} ELSE completed_at END', 'completed_at')},
      CASE WHEN {_OWNED} THEN 'none' ELSE CAST(c AS VARCHAR) END AS customer_meta,
      CASE WHEN {_OWNED} THEN CAST(o % 1000 AS VARCHAR) END AS duration,
      CASE WHEN {_OWNED} THEN locked_by END AS completed_by FROM scrape_job"""))
def complete_jobs(spark, sf):
    outcomes = job_outcomes(spark, sf).drop("error", "o")
    done = J.complete(A.scrape_job(spark, sf), outcomes, A.as_of())
    meta = lambda key: F.element_at("metadata", F.lit(key))
    return done.select("id", "status", "locked_by", _stamp("completed_at"), meta("customer").alias("customer_meta"),
                       meta("duration").alias("duration"), meta("completedBy").alias("completed_by"))


@query("fail_decision", jobs_sql(
    f"""SELECT id, CASE WHEN {_OWNED} AND attempts < max_attempts THEN 'queued' WHEN {_OWNED} THEN 'failed' ELSE status END
      AS status, CASE WHEN NOT {_OWNED} THEN locked_by END AS locked_by,
      {_stamp_sql(f'CASE WHEN {_OWNED} AND attempts >= max_attempts THEN {AS_OF} ELSE completed_at END', 'completed_at')},
      CASE WHEN {_OWNED} THEN 'network ' || o ELSE last_error END AS last_error,
      CASE WHEN {_OWNED} THEN locked_by END AS failed_by FROM scrape_job"""))
def fail_decision(spark, sf):
    failures = job_outcomes(spark, sf).select("id", "worker", "error", "metadata")
    rows = J.fail(A.scrape_job(spark, sf), failures, A.as_of())
    return rows.select("id", "status", "locked_by", _stamp("completed_at"), "last_error",
                       F.element_at("metadata", F.lit("lastFailedBy")).alias("failed_by"))


@query("jobs_newest_updated", jobs_sql(
    f"SELECT id, {_stamp_sql('updated_at', 'updated_at')} FROM (SELECT * FROM scrape_job ORDER BY updated_at DESC, id LIMIT 25)"))
def jobs_newest_updated(spark, sf):
    rows = A.scrape_job(spark, sf).orderBy(F.col("updated_at").desc(), "id").limit(25)
    return rows.select("id", _stamp("updated_at"))


@query("jobs_oldest_n", jobs_sql(
    "SELECT id, status FROM scrape_job WHERE status IN ('queued', 'failed') ORDER BY created_at, id LIMIT 50"))
def jobs_oldest_n(spark, sf):
    return J.oldest(J.in_status(A.scrape_job(spark, sf), "queued", "failed"), 50).select("id", "status")


@query("cleared_jobs", jobs_sql("SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM scrape_job"))
def cleared_jobs(spark, sf):
    """A published job table, before and after all its rows are deleted."""
    store = Snapshots(spark, scratch_path(spark, "jobs"))
    store.publish(A.scrape_job(spark, sf), 1)
    after = J.clear(store)
    return store.at(1).agg(F.count("*").alias("before")).withColumn("after", after.agg(F.count("*")).scalar())


@query("user_processor", jobs_sql("SELECT id, type || ' done' AS outcome FROM scrape_job WHERE status = 'queued'"))
def user_processor(spark, sf):
    def process(batches):
        for batch in batches:
            yield batch.assign(outcome=batch["type"] + " done")[["id", "outcome"]]
    queued = J.in_status(A.scrape_job(spark, sf), "queued").select("id", "type")
    return ingest.process_jobs(queued, process, "id string, outcome string")


@query("sql_functions", jobs_sql(
    f"""SELECT 'stats' AS kind, status AS id, count(*) AS n FROM scrape_job GROUP BY status
    UNION ALL SELECT 'claim w1', id, priority FROM (SELECT id, priority FROM scrape_job WHERE status = 'queued'
      OR (status = 'running' AND locked_at < {AS_OF} - INTERVAL 15 MINUTE) ORDER BY priority DESC, created_at, id LIMIT 10)
    UNION ALL SELECT 'retry', id, attempts FROM (SELECT id, attempts FROM scrape_job WHERE status = 'failed'
      AND attempts < max_attempts ORDER BY updated_at, id LIMIT 20)
    UNION ALL SELECT 'health', 'expired', count(*) FROM scrape_job WHERE status = 'running'
      AND locked_at < {AS_OF} - INTERVAL 10 MINUTE
    UNION ALL SELECT 'health', 'queued s', CAST(epoch({AS_OF}) - epoch(min(created_at)) AS BIGINT) FROM scrape_job WHERE status = 'queued'
    UNION ALL SELECT 'health', 'running s', CAST(epoch({AS_OF}) - epoch(min(locked_at)) AS BIGINT) FROM scrape_job WHERE status = 'running'"""))
def sql_functions(spark, sf):
    A.scrape_job(spark, sf).createOrReplaceTempView("catalog_jobs")
    sqlfuncs.register(spark, "catalog_jobs", A.AS_OF)
    return spark.sql("""
        SELECT 'stats' AS kind, status AS id, count AS n FROM get_queue_stats()
        UNION ALL (SELECT 'claim ' || locked_by, id, CAST(priority AS BIGINT) FROM claimable_jobs('w1', 15)
                   ORDER BY priority DESC, created_at, id LIMIT 10)
        UNION ALL (SELECT 'retry', id, CAST(attempts AS BIGINT) FROM get_retryable_jobs() ORDER BY updated_at, id LIMIT 20)
        UNION ALL SELECT 'health', 'expired', expired_locks FROM get_queue_health()
        UNION ALL SELECT 'health', 'queued s', oldest_queued_s FROM get_queue_health()
        UNION ALL SELECT 'health', 'running s', oldest_running_s FROM get_queue_health()""")


# ---- rate limits -------------------------------------------------------------------------------------------------

def refresh_triggers(spark: SparkSession, sf: str, key: str = "event_type") -> DataFrame:
    """Refresh requests: one per event, keyed by its type."""
    return A.table(spark, sf, "events").select(
        F.col(key).cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("request_id"))


@query("rate_usage", """SELECT key, ts_ms, CAST(sum(n) OVER (PARTITION BY key ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS BIGINT) AS minute,
  CAST(sum(n) OVER (PARTITION BY key ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS BIGINT) AS hour
  FROM (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ts_ms, count(*) AS n FROM events GROUP BY ALL)""")
def rate_usage(spark, sf):
    return R.usage(refresh_triggers(spark, sf)).select("key", "ts_ms", "minute", "hour")


# Each step judges the next request of every key against the accepted times of its last hour.
@query("rate_limit_sliding", """WITH RECURSIVE seq AS (
    SELECT event_type AS key, (epoch_us(ts) // 1000) AS ts_ms, event_id AS request_id,
      row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
  walk AS (
    SELECT key, request_id, rn, true AS allowed, [ts_ms] AS accepted FROM seq WHERE rn = 1
    UNION ALL
    SELECT s.key, s.request_id, s.rn, ok, CASE WHEN ok THEN list_append(recent, s.ts_ms) ELSE recent END
    FROM (SELECT s.*, list_filter(w.accepted, lambda t: s.ts_ms - t < 3600000) AS recent,
            len(list_filter(w.accepted, lambda t: s.ts_ms - t < 60000)) < 1
            AND len(list_filter(w.accepted, lambda t: s.ts_ms - t < 3600000)) < 3 AS ok
          FROM walk w JOIN seq s ON s.key = w.key AND s.rn = w.rn + 1) s)
  SELECT key, request_id, allowed FROM walk""")
def rate_limit_sliding(spark, sf):
    verdicts = R.sliding_log(refresh_triggers(spark, sf), per_minute=1, per_hour=3)
    return verdicts.select("key", "request_id", "allowed")


@query("rate_limit_fixed", """SELECT key, request_id, position, position <= 2 AS allowed FROM (
  SELECT event_type AS key, event_id AS request_id,
    row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) // 60000 ORDER BY (epoch_us(ts) // 1000), event_id) AS position FROM events)""")
def rate_limit_fixed(spark, sf):
    rows = R.fixed_minute(refresh_triggers(spark, sf), limit=2)
    return rows.select("key", "request_id", "position", "allowed")

"""Crawl-job accounting: plans, outcomes, retries, retention, queue statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas as S
from ..functions.text import merge_maps

LOCK_MINUTES, STUCK_MINUTES, RETRY_QUIET_MINUTES = 10, 30, 5
DEFAULT_PRIORITY = 5
ALERT_WINDOW_HOURS = 24


def before(moment: Column, **span: int) -> Column:
    return moment - F.make_dt_interval(**{unit: F.lit(n) for unit, n in span.items()})


def in_status(jobs: DataFrame, *statuses: str) -> DataFrame:
    return jobs.filter(F.col("status").isin(list(statuses)))


def oldest(jobs: DataFrame, limit: int, by: str = "created_at") -> DataFrame:
    return jobs.orderBy(by, "id").limit(limit)


def is_lock_expired(as_of: Column, minutes: int = LOCK_MINUTES) -> Column:
    return (F.col("status") == "running") & (F.col("locked_at") < before(as_of, mins=minutes))


def _unlock(jobs: DataFrame, where: Column, as_of: Column, **more: Column) -> DataFrame:
    """Back to the queue where the condition holds; `released` tells which rows changed."""
    hit = F.coalesce(where, F.lit(False))
    change = {
        "status": F.lit("queued"), "locked_at": F.lit(None).cast("timestamp"),
        "locked_by": F.lit(None).cast("string"), "updated_at": as_of, **more}
    marked = jobs.withColumn("released", hit)
    return marked.withColumns({c: F.when(F.col("released"), v).otherwise(F.col(c)) for c, v in change.items()})


def recover_expired(jobs: DataFrame, as_of: Column, minutes: int = LOCK_MINUTES) -> DataFrame:
    return _unlock(jobs, is_lock_expired(as_of, minutes), as_of)


def release_worker(jobs: DataFrame, worker: str, as_of: Column) -> DataFrame:
    return _unlock(jobs, F.col("locked_by") == worker, as_of)


def dispatch_plan(jobs: DataFrame, workers: list[str], limit: int, as_of: Column,
                  lock_minutes: int = LOCK_MINUTES) -> DataFrame:
    """The next `limit` jobs for a list of workers: highest priority, then oldest.

    The cut comes before the ranking, so only `limit` rows ever meet in one task.
    """
    free = recover_expired(jobs, as_of, lock_minutes)
    claimable = (F.col("status") == "queued") & (
        F.col("locked_at").isNull() | (F.col("locked_at") < before(as_of, mins=lock_minutes)))
    order = [F.col("priority").desc(), F.col("created_at"), F.col("id")]
    top = free.filter(claimable).select("id", "type", "target_url", "priority", "attempts", "max_attempts",
                                        "metadata", "created_at").orderBy(*order).limit(limit)
    names = F.array(*[F.lit(w) for w in workers])
    return (top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
            .withColumn("locked_by", F.element_at(names, ((F.col("position") - 1) % len(workers) + 1).cast("int")))
            .withColumn("locked_at", as_of).withColumn("status", F.lit("running"))
            .withColumn("attempts", F.col("attempts") + 1))


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests(type, target_url, priority, metadata, seq) against the open jobs.

    An open job of the same type and url absorbs them and takes the greatest priority; otherwise one
    job is added with the greatest priority, 5 where no request names one, and the first request's metadata.  Returns the change
    rows: id, type, target_url, priority, metadata, action.
    """
    wanted = requests.groupBy("type", "target_url").agg(
        F.coalesce(F.max("priority"), F.lit(DEFAULT_PRIORITY)).alias("_asked"), F.min_by("metadata", "seq").alias("metadata"))
    open_jobs = in_status(jobs, *S.OPEN_STATUSES).groupBy("type", "target_url").agg(
        F.min(F.struct("id", "priority")).alias("_open"))
    return wanted.join(open_jobs, ["type", "target_url"], "left").select(
        F.coalesce(F.col("_open.id"), S.row_id(F.concat_ws("|", "type", "target_url"))).alias("id"),
        "type", "target_url",
        F.greatest(F.col("_asked"), F.coalesce(F.col("_open.priority"), F.col("_asked"))).alias("priority"),
        "metadata", F.when(F.col("_open").isNull(), "insert").otherwise("raise").alias("action"))


def apply_enqueue(jobs: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The job table after `enqueue`: raised priorities joined in, new jobs appended."""
    raised = changes.filter("action = 'raise'").select("id", F.col("priority").alias("_p"))
    kept = (jobs.join(raised, "id", "left")
            .withColumn("updated_at", F.when(F.col("_p").isNotNull(), as_of).otherwise(F.col("updated_at")))
            .withColumn("priority", F.coalesce("_p", "priority")).drop("_p"))
    return kept.unionByName(new_jobs(changes.filter("action = 'insert'").drop("action"), as_of).select(*kept.columns))


def new_jobs(requests: DataFrame, as_of: Column) -> DataFrame:
    """Complete job rows for requests(id, type, target_url, priority, metadata)."""
    given = {f.name: F.col(f.name).cast(f.dataType) if f.name in requests.columns
             else F.lit(None).cast(f.dataType) for f in S.SCRAPE_JOB}
    stamped = {**given, "created_at": as_of, "updated_at": as_of}
    return S.with_defaults(requests.select(*[c.alias(n) for n, c in stamped.items()]), "scrape_job")


def terminal_stamp(new_status: Column, old_status: Column, completed_at: Column, as_of: Column) -> Column:
    """completed_at after an update: set on the first entry to a terminal status."""
    entering = new_status.isin(S.TERMINAL_STATUSES) & ~old_status.isin(S.TERMINAL_STATUSES)
    return F.when(entering, as_of).otherwise(completed_at)


def _owned(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Left join on id and lock owner: an outcome of a worker that lost its lock matches nothing."""
    renamed = outcomes.select(
        "id", F.col("worker").alias("locked_by"),
        *[F.col(c).alias(f"_{c}") for c in outcomes.columns if c not in ("id", "worker")], F.lit(True).alias("_hit"))
    return jobs.join(renamed, ["id", "locked_by"], "left")


def complete(jobs: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Outcomes(id, worker, duration, items, metadata) of jobs that ended well."""
    hit = F.col("_hit").isNotNull()
    stamp = F.create_map(F.lit("duration"), F.col("_duration").cast("string"),
                         F.lit("itemsProcessed"), F.col("_items").cast("string"),
                         F.lit("completedBy"), F.col("locked_by"))
    joined = _owned(jobs, outcomes)
    return _finish(joined, jobs, F.when(hit, "completed").otherwise(F.col("status")), as_of, hit,
                   metadata=F.when(hit, merge_maps(F.col("_metadata"), stamp)).otherwise(F.col("metadata")))


def fail(jobs: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """Failures(id, worker, error, metadata): back to the queue while attempts are left, else failed."""
    hit = F.col("_hit").isNotNull()
    retry = F.coalesce("attempts", F.lit(0)) < F.coalesce("max_attempts", F.lit(3))
    status = F.when(hit & retry, "queued").when(hit, "failed").otherwise(F.col("status"))
    stamp = F.create_map(F.lit("lastFailedBy"), F.col("locked_by"),
                         F.lit("lastFailedAt"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    merged = merge_maps(merge_maps(F.col("metadata"), F.col("_metadata")), stamp)
    joined = _owned(jobs, failures)
    return _finish(joined, jobs, status, as_of, hit,
                   metadata=F.when(hit, merged).otherwise(F.col("metadata")),
                   last_error=F.when(hit, F.col("_error")).otherwise(F.col("last_error")))


def _finish(joined: DataFrame, jobs: DataFrame, status: Column, as_of: Column, hit: Column, **more: Column
            ) -> DataFrame:
    change = {
        "status": status, "completed_at": terminal_stamp(status, F.col("status"), F.col("completed_at"), as_of),
        "locked_at": F.when(~hit, F.col("locked_at")), "locked_by": F.when(~hit, F.col("locked_by")),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")), **more}
    return joined.select(*[change.get(c, F.col(c)).alias(c) for c in jobs.columns], hit.alias("changed"))


def retryable(jobs: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    quiet = F.col("last_error").isNull() | (F.col("updated_at") < before(as_of, mins=RETRY_QUIET_MINUTES))
    return oldest(jobs.filter((F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts")) & quiet),
                  limit, "updated_at")


def requeue(jobs: DataFrame, as_of: Column, limit: int = 100, job_id: str | None = None) -> DataFrame:
    """Failed jobs with attempts left go back to the queue: the oldest `limit`, or one by id."""
    may = jobs.filter((F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts")))
    picked = may.filter(F.col("id") == job_id) if job_id else oldest(may, limit, "updated_at")
    marked = jobs.join(picked.select("id", F.lit(True).alias("_pick")), "id", "left")
    return _unlock(marked, F.col("_pick"), as_of, last_error=F.lit(None).cast("string")).drop("_pick")


def is_outdated(as_of: Column, rule: str, amount: int) -> Column:
    """Rows a retention rule deletes: terminal_hours, completed_days or terminal_days."""
    terminal = F.col("status").isin(S.TERMINAL_STATUSES)
    rules = {
        "terminal_hours": lambda: terminal & (F.col("completed_at") < before(as_of, hours=amount)),
        "completed_days": lambda: (F.col("status") == "completed") & (F.col("updated_at") < before(as_of, days=amount)),
        "terminal_days": lambda: terminal & (F.col("completed_at") < before(as_of, days=amount)),
    }
    return F.coalesce(rules[rule](), F.lit(False))


def apply_retention(jobs: DataFrame, as_of: Column, rule: str = "terminal_hours", amount: int = 24) -> DataFrame:
    return jobs.filter(~is_outdated(as_of, rule, amount))


def clear(store) -> DataFrame:
    """Deletes all jobs of a published table: its next snapshot has none.  Returns the table as it is read then."""
    versions = store.versions()
    store.publish(store.at(versions[-1]).filter(F.lit(False)), versions[-1] + 1)
    return store.read()


def count_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("count"),
                                      F.count("locked_at").alias("locked_count"))


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in S.JOB_STATUSES]


def queue_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*_status_counts(), F.count("locked_at").alias("locked"))


def queue_stats_by_type(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status", "type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("attempts").alias("avg_attempts"),
        F.min("created_at").alias("oldest_job"), F.max("created_at").alias("newest_job"))


def queue_health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row; ages in seconds, 0 when there is nothing to age."""
    age = lambda start: F.coalesce(F.unix_seconds(as_of) - F.unix_seconds(start), F.lit(0))
    is_status = lambda s: F.col("status") == s
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *[F.count_if(is_status(s)).alias(f"{s}_jobs") for s in S.JOB_STATUSES],
        F.count("locked_at").alias("locked_jobs"),
        F.count_if(is_lock_expired(as_of)).alias("expired_locks"),
        F.count_if(is_status("failed") & (F.col("attempts") < F.col("max_attempts"))).alias("retryable_jobs"),
        age(F.min(F.when(is_status("queued"), F.col("created_at")))).alias("oldest_queued_age_s"),
        age(F.min(F.when(is_status("running"), F.col("locked_at")))).alias("oldest_running_age_s"))


def success_rate(good: Column, bad: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(good * 100.0, good + bad), F.lit(empty))


def recent_outcomes(jobs: DataFrame, as_of: Column, hours: int = ALERT_WINDOW_HOURS) -> DataFrame:
    """Completed and failed jobs of the last day; the rate is 100 when nothing finished."""
    window = jobs.filter((F.col("completed_at") >= before(as_of, hours=hours)) & (F.col("completed_at") <= as_of))
    return window.agg(*[F.count_if(F.col("status") == s).alias(s) for s in S.TERMINAL_STATUSES]).withColumn(
        "success_rate", success_rate(F.col("completed"), F.col("failed"), 100.0))

"""The job-queue functions as SQL table functions over a job table."""

from __future__ import annotations

from pyspark.sql import SparkSession

# {jobs} is the job view, {now} the moment the functions work with.
_FUNCTIONS = {
    "get_queue_stats()": ("status STRING, count BIGINT, locked_count BIGINT", """
        SELECT status, count(*), count(locked_at) FROM {jobs} GROUP BY status"""),
    "get_queue_health()": (
        "total_jobs BIGINT, queued_jobs BIGINT, running_jobs BIGINT, completed_jobs BIGINT, failed_jobs BIGINT, "
        "locked_jobs BIGINT, expired_locks BIGINT, retryable_jobs BIGINT, oldest_queued_s BIGINT, oldest_running_s BIGINT", """
        SELECT count(*), count_if(status = 'queued'), count_if(status = 'running'), count_if(status = 'completed'),
               count_if(status = 'failed'), count(locked_at),
               count_if(status = 'running' AND locked_at < {now} - INTERVAL 10 MINUTES),
               count_if(status = 'failed' AND attempts < max_attempts),
               coalesce(unix_seconds({now}) - unix_seconds(min(created_at) FILTER (WHERE status = 'queued')), 0),
               coalesce(unix_seconds({now}) - unix_seconds(min(locked_at) FILTER (WHERE status = 'running')), 0)
        FROM {jobs}"""),
    "get_retryable_jobs()": (
        "id STRING, type STRING, target_url STRING, attempts INT, max_attempts INT, updated_at TIMESTAMP", """
        SELECT id, type, target_url, attempts, max_attempts, updated_at FROM {jobs}
        WHERE status = 'failed' AND attempts < max_attempts
          AND (last_error IS NULL OR updated_at < {now} - INTERVAL 5 MINUTES)"""),
    "claimable_jobs(worker STRING, lock_minutes INT)": (
        "id STRING, type STRING, target_url STRING, priority INT, attempts INT, created_at TIMESTAMP, locked_by STRING", """
        SELECT id, type, target_url, priority, attempts + 1, created_at, claimable_jobs.worker FROM {jobs}
        WHERE (status = 'queued' AND (locked_at IS NULL
               OR locked_at < {now} - make_dt_interval(0, 0, claimable_jobs.lock_minutes)))
           OR (status = 'running' AND locked_at < {now} - make_dt_interval(0, 0, claimable_jobs.lock_minutes))"""),
}


def register(spark: SparkSession, jobs_view: str, as_of: str) -> list[str]:
    """Create the functions in the session.  A caller orders and limits their rows: ORDER BY ... LIMIT n."""
    for signature, (columns, body) in _FUNCTIONS.items():
        text = body.format(jobs=jobs_view, now=f"TIMESTAMP '{as_of}'")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE({columns}) RETURN {text}")
    return [signature.split("(")[0] for signature in _FUNCTIONS]

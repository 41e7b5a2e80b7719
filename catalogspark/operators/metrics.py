"""Operational analytics over logs, job outcomes, alerts and clickstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .jobs import queue_totals

LEVELS = ["error", "warn", "info", "debug"]
COMPONENTS = ["scraper", "crawler", "queue", "database", "storage"]
MEMORY_ALERT, ERROR_ALERT, MEMORY_LIMIT, ERROR_LIMIT = 85.0, 5.0, 90.0, 10.0
SLOW_JOB_MS, LOW_SUCCESS, HIGH_MEMORY, FAILED_SHARE = 30_000, 80.0, 80.0, 0.1


def percent(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0))


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery, so that no join is needed to place it beside another."""
    return df.select(F.struct(*df.columns)).scalar()


def total_rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def database_stats(navigation: DataFrame, categories: DataFrame, products: DataFrame, jobs: DataFrame) -> DataFrame:
    return queue_totals(jobs).drop("locked").withColumns({
        "navigation_count": total_rows(navigation), "category_count": total_rows(categories),
        "product_count": total_rows(products)})


def top_k(df: DataFrame, by: str, k: int, name: str = "count") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), by).limit(k)


# ---- logs ------------------------------------------------------------------------------------

def filter_logs(logs: DataFrame, level: str | None = None, component: str | None = None, search: str | None = None,
                start: Column | None = None, end: Column | None = None, limit: int | None = None) -> DataFrame:
    """Each given argument narrows the rows; metadata is JSON text or a map; both time bounds are inclusive.

    With a limit the newest rows are kept.
    """
    if level is not None:
        logs = logs.filter(F.col("level") == level)
    if component is not None:
        logs = logs.filter(F.col("component") == component)
    if search is not None:
        wanted = search.lower()
        kind = logs.schema["metadata"].dataType.simpleString()
        metadata = F.col("metadata") if kind == "string" else F.to_json("metadata")
        found = F.lower("message").contains(wanted) | F.lower(metadata).contains(wanted)
        logs = logs.filter(F.coalesce(found, F.lower("message").contains(wanted), F.lower(metadata).contains(wanted)))
    if start is not None:
        logs = logs.filter(F.col("timestamp") >= start)
    if end is not None:
        logs = logs.filter(F.col("timestamp") <= end)
    return logs if limit is None else logs.orderBy(F.col("timestamp").desc(), "message", "component").limit(limit)


def log_stats(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("level") == v).alias(f"level_{v}") for v in LEVELS],
        *[F.count_if(F.col("component") == v).alias(f"component_{v}") for v in COMPONENTS])


def top_errors(logs: DataFrame, k: int = 5) -> DataFrame:
    return top_k(logs.filter("level = 'error'"), "message", k)


def log_overview(logs: DataFrame, as_of: Column, hours: int = 24, k: int = 5) -> DataFrame:
    """One row: total, first and last timestamp, rows and errors of the last hours, and the k most frequent error texts.

    Messages are counted before the few that are kept are gathered.
    """
    recent = (F.col("timestamp") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("timestamp") <= as_of)
    rows = logs.agg(F.count(F.lit(1)).alias("total"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
                    F.count_if(recent).alias("recent"), F.count_if(recent & (F.col("level") == "error")).alias("recent_errors"))
    most = top_errors(logs, k).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "message"))),
                                               lambda t: F.struct(t["message"].alias("message"), (-t["n"]).alias("count"))).alias("top"))
    return rows.withColumn("top_errors", most.scalar())


def http_requests(access: DataFrame) -> DataFrame:
    """Finished requests of an access log, per method and status."""
    return (access.filter(F.col("message") == "Request completed").groupBy("method", "statusCode")
            .agg(F.count(F.lit(1)).alias("requests"), F.avg("duration").alias("avg_duration"),
                 F.max("duration").alias("max_duration")))


# ---- jobs and workers --------------------------------------------------------------------------

def worker_metrics(outcomes: DataFrame, started_at: Column, as_of: Column) -> DataFrame:
    """Outcomes(success, duration, ended_at): the mean time is over all jobs, good or bad."""
    raw = outcomes.agg(
        F.count(F.lit(1)).alias("jobs_processed"), F.count_if("success").alias("jobs_succeeded"),
        F.count_if(~F.col("success")).alias("jobs_failed"),
        F.coalesce(F.sum("duration"), F.lit(0)).alias("total_processing_time"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("average_processing_time"),
        F.max("ended_at").alias("last_job_processed_at"))
    minutes = (F.unix_millis(as_of) - F.unix_millis(started_at)) / 60000.0
    return raw.withColumns({
        "success_rate": F.round(percent(F.col("jobs_succeeded"), F.col("jobs_processed")), 2),
        "failure_rate": F.round(percent(F.col("jobs_failed"), F.col("jobs_processed")), 2),
        "throughput": F.round(F.coalesce(F.try_divide(F.col("jobs_processed"), minutes), F.lit(0.0)), 2)})


def scraping_metrics(events: DataFrame) -> DataFrame:
    """Events(kind in start/success/failure/image/error, duration, items): the mean time is over successes."""
    is_kind = lambda kind: F.col("kind") == kind
    good = F.when(is_kind("success"), F.col("duration"))
    raw = events.agg(
        F.count_if(is_kind("start")).alias("jobs_processed"), F.count_if(is_kind("success")).alias("jobs_succeeded"),
        F.count_if(is_kind("failure")).alias("jobs_failed"),
        F.coalesce(F.sum(good), F.lit(0)).alias("total_scraping_time"),
        F.coalesce(F.avg(good), F.lit(0.0)).alias("average_scraping_time"),
        F.coalesce(F.sum(F.when(is_kind("success"), F.col("items"))), F.lit(0)).alias("items_scraped"),
        F.count_if(is_kind("image")).alias("images_processed"),
        F.count_if(is_kind("error")).alias("errors_encountered"))
    return raw.withColumns({"success_rate": percent(F.col("jobs_succeeded"), F.col("jobs_processed")),
                            "error_rate": percent(F.col("jobs_failed"), F.col("jobs_processed"))})


def performance_report(scraping: DataFrame, queue: DataFrame, memory_percent: float | None = None) -> DataFrame:
    """Scraping metrics (one row) beside queue totals (one row), with the texts of the rules that fire."""
    q = lambda name: F.col(f"_q.{name}")
    active = q("queued") + q("running") + q("completed")
    # The texts of the rules.
    rules = [
        (F.col("success_rate") < LOW_SUCCESS, "Consider investigating frequent job failures"),
        (F.col("average_scraping_time") > SLOW_JOB_MS,
         "Average processing time is high - consider optimizing scrapers"),
        (F.lit(memory_percent) > HIGH_MEMORY, "Memory usage is high - consider increasing available memory"),
        (q("failed") > q("completed") * FAILED_SHARE, "High number of failed jobs - review error patterns"),
    ]
    return scraping.withColumn("_q", one_row(queue)).select(
        F.col("jobs_processed").alias("total_jobs"), "success_rate", "error_rate",
        F.col("average_scraping_time").alias("average_processing_time"),
        F.coalesce(F.try_divide("items_scraped", "jobs_processed"), F.lit(0.0)).alias("items_per_job"),
        F.coalesce(F.try_divide("images_processed", "jobs_processed"), F.lit(0.0)).alias("images_per_job"),
        F.when(q("queued") > 0, percent(q("running"), q("queued"))).otherwise(100.0).alias("queue_efficiency"),
        percent(q("completed"), active).alias("completion_rate"),
        F.array_compact(F.array(*[F.when(c, t) for c, t in rules])).alias("recommendations"))


def dashboard_health(scraping: DataFrame, memory_percent: Column, has_queue: Column, is_running: Column) -> DataFrame:
    """Four checks; the overall state is the worst of them."""
    checks = {
        "memory": F.when(memory_percent < MEMORY_LIMIT, "healthy").otherwise("warning"),
        "error_rate_check": F.when(F.col("error_rate") < ERROR_LIMIT, "healthy").otherwise("warning"),
        "queue": F.when(has_queue, "healthy").otherwise("unhealthy"),
        "worker": F.when(is_running, "healthy").otherwise("unhealthy"),
    }
    states = F.array(*[F.col(c) for c in checks])
    overall = (F.when(F.array_contains(states, "unhealthy"), "unhealthy")
               .when(F.array_contains(states, "warning"), "warning").otherwise("healthy"))
    return scraping.withColumns(checks).select(*checks, "error_rate").withColumn("status", overall)


def system_alerts(measures: DataFrame) -> DataFrame:
    """Measures(ts, memory_percent, error_rate) as warning rows, one per rule that fires."""
    warning = lambda ident, title, text, value, source: F.struct(
        F.lit(ident).alias("id"), F.lit("warning").alias("level"), F.lit(title).alias("title"),
        F.format_string(f"{text} is at %.2f%%", value).alias("message"), F.lit(source).alias("source"))
    fired = F.array_compact(F.array(
        F.when(F.col("memory_percent") > MEMORY_ALERT, warning(
            "memory-high", "High Memory Usage", "Memory usage", F.col("memory_percent"), "system-monitor")),
        F.when(F.col("error_rate") > ERROR_ALERT, warning(
            "error-rate-high", "High Error Rate", "Error rate", F.col("error_rate"), "scraper-metrics"))))
    return measures.select("ts", F.inline(fired))


def first_alerts(alerts: DataFrame, level: str | None = None, limit: int = 50) -> DataFrame:
    """The first alerts of a level, each row with the total before the cut."""
    chosen = alerts if level is None else alerts.filter(F.col("level") == level)
    return chosen.orderBy("ts", "id").limit(limit).withColumn("total", total_rows(chosen))


def error_windows(logs: DataFrame, minutes: int = 5, threshold: int = 10) -> DataFrame:
    """Errors per tumbling window, whether they raise an alert, and the rate projected to the full window.

    Batch and streaming: give the frame a watermark to use it on a stream.
    """
    window = F.window("timestamp", f"{minutes} minutes")
    seconds = minutes * 60.0
    elapsed = F.least(F.lit(seconds), (F.unix_millis("last_seen") - F.unix_millis("window_start")) / 1000.0)
    return (logs.filter("level = 'error'").groupBy(window)
            .agg(F.count(F.lit(1)).alias("errors"), F.max("timestamp").alias("last_seen"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "errors",
                    "last_seen")
            .withColumn("alert", F.col("errors") > threshold)
            .withColumn("projected_rate", F.coalesce(F.try_divide(F.col("errors") * seconds, elapsed), F.lit(0.0)))
            .drop("last_seen"))


def metrics_history(samples: DataFrame, interval: str, slide: str | None = None) -> DataFrame:
    """Samples(ts, processed, succeeded, failed, memory) rolled up per interval.  Batch and streaming."""
    return (samples.groupBy(F.window("ts", interval, slide or interval)).agg(
        F.count(F.lit(1)).alias("points"), F.sum("processed").alias("jobs"), F.sum("succeeded").alias("_ok"),
        F.sum("failed").alias("_bad"), F.max("memory").alias("peak_memory"))
        .select(F.col("window.start").alias("window_start"), "points", "jobs",
                percent(F.col("_ok"), F.col("jobs")).alias("success_rate"),
                percent(F.col("_bad"), F.col("jobs")).alias("error_rate"), "peak_memory"))


def history_summary(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("data_points"), F.avg("success_rate").alias("average_success_rate"),
        F.avg("error_rate").alias("average_error_rate"), F.max("peak_memory").alias("peak_memory"),
        F.sum("jobs").alias("total_jobs"))


# ---- clickstream -------------------------------------------------------------------------------

def payload_events(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("sessionId").alias("session_id"), F.col("userId").alias("user_id"),
                           F.inline("events"))


def payload_metrics(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("sessionId").alias("session_id"), F.inline("performanceMetrics"))


def analytics_top(clicks: DataFrame, as_of: Column, by: str, k: int = 10, hours: int = 24) -> DataFrame:
    """The pages or events (column `by`) seen most often in the last day."""
    recent = clicks.filter((F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= as_of))
    return top_k(recent.filter(F.col(by).isNotNull()), by, k)


def analytics_summary(clicks: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Last day: sessions, page views, events, mean session length, mean value per metric, error share."""
    recent = clicks.filter((F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= as_of))
    is_event = lambda name: F.col("event") == name
    # First one row per session, then one row in all: both steps combine before they shuffle.
    sessions = recent.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_event("view")).alias("views"),
        F.count_if(is_event("error")).alias("errors"), (F.max("ts_ms") - F.min("ts_ms")).alias("length_ms"),
        F.sum(F.when(is_event("view"), F.col("value"))).alias("view_value"),
        F.sum(F.when(is_event("click"), F.col("value"))).alias("click_value"),
        F.count_if(is_event("click")).alias("clicks"))
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum("views").alias("total_page_views"),
        F.sum("n").alias("total_events"), F.avg("length_ms").alias("average_session_ms"),
        F.try_divide(F.sum("view_value"), F.sum("views")).alias("average_page_load"),
        F.try_divide(F.sum("click_value"), F.sum("clicks")).alias("average_api_response"),
        percent(F.sum("errors"), F.sum("n")).alias("error_rate"))


def session_summary(clicks: DataFrame, metrics: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Per session: events, metric rows, length since the start in its id, and its most frequent events."""
    counts = clicks.groupBy("session_id", "event").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms"))
    totals = counts.groupBy("session_id").agg(F.sum("n").alias("events"), F.max("last_ms").alias("last_ms"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("n").desc(), "event"))
    # At most `top` rows per session survive the rank, so the list below is bounded.
    best = (counts.withColumn("rn", rank).filter(F.col("rn") <= top).groupBy("session_id")
            .agg(F.sort_array(F.collect_list(F.struct("rn", "event", "n"))).alias("top_events")))
    start = F.split("session_id", "-")[0].try_cast("bigint")
    out = totals.join(best, "session_id").withColumn("duration_ms", F.col("last_ms") - start).drop("last_ms")
    if metrics is None:
        return out.withColumn("metrics", F.lit(0).cast("bigint"))
    per_session = metrics.groupBy("session_id").agg(F.count(F.lit(1)).alias("metrics"))
    return out.join(per_session, "session_id", "left").withColumn("metrics", F.coalesce("metrics", F.lit(0)))


def metric_rollup(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"),
                                    F.max("value").alias("max_value"), F.min("value").alias("min_value"))


SKETCH_K = 400   # a quantile of a merged sketch is off by less than a hundredth of the rows, nearly always


def percentile_sketches(metrics: DataFrame, by: list[str], ts: str = "ts", window: str = "1 hour", value: str = "value") -> DataFrame:
    """Per group and window: n, min_value, max_value and a quantile sketch of a measure, which merges into longer windows.

    Sketches are built map-side, so no group is gathered, and are as long as their size allows, however many rows there are.
    """
    start = F.window(ts, window)["start"].alias("window_start")
    return metrics.where(F.col(value).isNotNull()).groupBy(*by, start).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str], window: str | None = None) -> DataFrame:
    """Sketches of longer windows, or of all time, from those of shorter ones; the measures are not read again."""
    keys = [*by, *([F.window("window_start", window)["start"].alias("window_start")] if window else [])]
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def percentiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Replace the sketch by quantiles, e.g. {"p50": 0.5, "p95": 0.95}."""
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in shares.items()}
    return sketches.withColumns(found).drop("sketch")

"""Log, alert, cache and clickstream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import classify as K, keys, text as X
from ..operators import freshness as C, jobs as J, metrics as M, timeline as T, validate as V
from ..session import scratch_path
from ..sources import adapters as A, exports, tables as R
from .queries_jobs import OPEN_JOBS_SQL, _stamp, _stamp_sql
from .registry import query
from .views_sql import EVENTS_AS_OF, SITE, with_views


def views(sql: str, *names: str, **extra: str) -> str:
    return with_views(sql, *names, **extra)


@query("db_stats", views(
    """SELECT (SELECT count(*) FROM navigation) AS navigation_count, (SELECT count(*) FROM category) AS category_count,
      (SELECT count(*) FROM product) AS product_count, count(*) FILTER (status = 'queued') AS queued,
      count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed,
      count(*) FILTER (status = 'failed') AS failed FROM scrape_job""", "navigation", "category", "product", "scrape_job"))
def db_stats(spark, sf):
    return M.database_stats(A.navigation(spark, sf), A.category(spark, sf), A.product(spark, sf), A.scrape_job(spark, sf))


# ---- logs and alerts -----------------------------------------------------------------------------------------

_LOG_WHERE = """component = 'queue' AND (contains(lower(message), 'rr') OR contains(lower(metadata), '"k": 7'))
  AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'"""


@query("log_search", views(f"SELECT event_id, level, message FROM log WHERE {_LOG_WHERE}", "log"))
def log_search(spark, sf):
    stamp = lambda text: F.lit(text).cast("timestamp")
    error_rows = M.filter_logs(A.log(spark, sf), component="queue", search="RR", start=stamp("2024-01-05 00:00:00"),
                               end=stamp("2024-01-20 00:00:00"))
    key_rows = M.filter_logs(A.log(spark, sf), component="queue", search='"K": 7', start=stamp("2024-01-05 00:00:00"),
                             end=stamp("2024-01-20 00:00:00"))
    return error_rows.unionByName(key_rows).select("event_id", "level", "message").distinct()


@query("log_search_source", views(
    """SELECT strftime(date_trunc('millisecond', timestamp), '%Y-%m-%d %H:%M:%S.%g') AS at, message, component FROM log
    WHERE level = 'info' AND (contains(lower(message), 'ick') OR contains(lower(metadata), 'ick')) ORDER BY date_trunc('millisecond', timestamp) DESC, message, component LIMIT 200""", "log"))
def log_search_source(spark, sf):
    """The newest 200 of the lines found, read through the log source, whose metadata is a map."""
    path = scratch_path(spark, "log-lines")
    A.log(spark, sf).drop("event_id").withColumn("metadata", R.json_map(F.col("metadata"))).write.json(path)
    found = M.filter_logs(R.read_logs(spark, path), level="info", search="ick", limit=200)
    return found.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "message", "component")


@query("log_scan", views(
    """SELECT level, component, count(*) AS n, CAST(max(k) AS BIGINT) AS max_k
    FROM (SELECT *, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM log) GROUP BY level, component""", "log"))
def log_scan(spark, sf):
    """Log rows written as JSON lines and scanned with the log schema."""
    path = scratch_path(spark, "log-lines")
    A.log(spark, sf).drop("event_id").withColumn("metadata", R.json_map(F.col("metadata"))).write.json(path)
    k = F.element_at("metadata", "k").cast("bigint")
    return R.read_logs(spark, path).groupBy("level", "component").agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("max_k"))


@query("http_access", """SELECT method, CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS "statusCode",
  count(*) AS requests, round(avg(ms), 8) AS avg_duration, CAST(max(ms) AS BIGINT) AS max_duration
  FROM (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS ms, CASE WHEN user_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method
        FROM events WHERE event_type <> 'signup') GROUP BY ALL""")
def http_access(spark, sf):
    """Access-log lines derived from the events, written as JSON lines and scanned back."""
    path = scratch_path(spark, "access-lines")
    kind = F.col("event_type")
    A.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "signup", "Request started").otherwise("Request completed").alias("message"),
        F.when(F.col("user_id") % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/"), kind).alias("url"), F.when(kind == "error", 500).otherwise(200).alias("statusCode"),
        F.floor(F.col("value") * 10).alias("duration")).write.json(path)
    rows = M.http_requests(R.read_http_access(spark, path))
    return rows.withColumn("avg_duration", F.round("avg_duration", 8))


@query("log_stats", views(
    f"""SELECT count(*) AS total, {', '.join(f"count(*) FILTER (level = '{v}') AS level_{v}" for v in M.LEVELS)},
    {', '.join(f"count(*) FILTER (component = '{v}') AS component_{v}" for v in M.COMPONENTS)} FROM log""", "log"))
def log_stats(spark, sf):
    return M.log_stats(A.log(spark, sf))


@query("log_overview", views(
    """SELECT count(*) AS total, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_at,
      count(*) FILTER (timestamp > TIMESTAMP '2024-01-19 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00') AS recent,
      count(*) FILTER (level = 'error' AND timestamp > TIMESTAMP '2024-01-19 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00') AS recent_errors,
      (SELECT string_agg(m || '=' || n, ';' ORDER BY n DESC, m) FROM (SELECT message || metadata AS m, count(*) AS n FROM log
        WHERE level = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_errors FROM log""", "log"))
def log_overview(spark, sf):
    rows = M.log_overview(A.log(spark, sf).withColumn("message", F.concat("message", "metadata")), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("total", stamp("first_at"), stamp("last_at"), "recent", "recent_errors", F.array_join(
        F.transform("top_errors", lambda t: F.concat(t["message"], F.lit("="), t["count"].cast("string"))), ";").alias("top_errors"))


@query("top_errors", views(
    """SELECT message, count(*) AS count FROM (SELECT message || metadata AS message, level FROM log) WHERE level = 'error'
    GROUP BY message ORDER BY count DESC, message LIMIT 5""", "log"))
def top_errors(spark, sf):
    return M.top_errors(A.log(spark, sf).withColumn("message", F.concat("message", "metadata")))


def system_measures(spark: SparkSession, sf: str) -> DataFrame:
    """One measure per hour of events: mean value as memory percent, share of error events."""
    return (A.log(spark, sf).join(A.table(spark, sf, "events").select("event_id", "value"), "event_id")
            .groupBy(F.date_trunc("hour", "timestamp").alias("ts"))
            .agg(F.round(F.least(F.lit(100.0), F.avg("value") * 4), 4).alias("memory_percent"),
                 M.percent(F.count_if(F.col("level") == "error"), F.count(F.lit(1))).alias("error_rate")))


_MEASURES = """SELECT date_trunc('hour', ts) AS ts, round(least(100.0, avg(value) * 4), 4) AS memory_percent,
  count(*) FILTER (event_type = 'error') * 100.0 / count(*) AS error_rate FROM events GROUP BY 1"""
_ALERTS = """SELECT ts, 'memory-high' AS id, 'High Memory Usage' AS title,
    'Memory usage is at ' || format('{:.2f}', round(memory_percent, 2)) || '%' AS message FROM measures WHERE memory_percent > 85
  UNION ALL SELECT ts, 'error-rate-high', 'High Error Rate', 'Error rate is at ' || format('{:.2f}', round(error_rate, 2)) || '%'
  FROM measures WHERE error_rate > 5"""


@query("alerts", views(
    f"""SELECT {_stamp_sql('ts', 'ts')}, id, title, message, '#ffcc00' AS color FROM alerts""", measures=_MEASURES, alerts=_ALERTS))
def alerts(spark, sf):
    rows = M.system_alerts(system_measures(spark, sf))
    return rows.select(_stamp("ts"), "id", "title", "message", K.alert_colour(F.col("level")).alias("color"))


@query("first_n_alerts", views(
    f"""SELECT {_stamp_sql('ts', 'ts')}, id, (SELECT count(*) FROM alerts) AS total
    FROM (SELECT * FROM alerts ORDER BY ts, id LIMIT 50)""", measures=_MEASURES, alerts=_ALERTS))
def first_n_alerts(spark, sf):
    rows = M.first_alerts(M.system_alerts(system_measures(spark, sf)), "warning", 50)
    return rows.select(_stamp("ts"), "id", "total")


@query("alert_payload", views(
    """SELECT event_id, CASE level WHEN 'error' THEN '#ff6600' ELSE '#808080' END AS color,
      '🚨 ' || upper(level) || ': ' || message AS text, 4 AS fields FROM log WHERE level <> 'info'""", "log"))
def alert_payload(spark, sf):
    logs = A.log(spark, sf).filter("level <> 'info'")
    payload = K.webhook_payload(F.col("level"), F.col("message"), F.col("message"), F.col("component"),
                                F.col("timestamp").cast("string"), R.json_map(F.col("metadata")))
    parsed = F.parse_json(payload)
    get = lambda path: F.variant_get(parsed, path, "string")
    return logs.select("event_id", get("$.attachments[0].color").alias("color"), get("$.text").alias("text"),
                       F.size(F.variant_get(parsed, "$.attachments[0].fields", "array<variant>")).alias("fields"))


# ---- workers ----------------------------------------------------------------------------------------------------

@query("worker_metrics", f"""SELECT n AS jobs_processed, ok AS jobs_succeeded, n - ok AS jobs_failed,
    total AS total_processing_time, round(total * 1.0 / n, 4) AS average_processing_time, last_at AS last_job_processed_at,
    round(ok * 100.0 / n, 2) AS success_rate, round((n - ok) * 100.0 / n, 2) AS failure_rate, round(n / 43200.0, 2) AS throughput
  FROM (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total,
    {_stamp_sql('max(ts)', 'last_at')} FROM events)""")
def worker_metrics(spark, sf):
    outcomes = A.table(spark, sf, "events").select(
        (F.col("event_type") != "error").alias("success"), F.floor(F.col("value") * 1000).alias("duration"),
        F.col("ts").cast("timestamp").alias("ended_at"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = M.worker_metrics(outcomes, start, A.events_as_of())
    return rows.withColumn("average_processing_time", F.round("average_processing_time", 4)).withColumn(
        "last_job_processed_at", F.date_format("last_job_processed_at", "yyyy-MM-dd HH:mm:ss"))


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """Scraping log rows: every event starts a job, and its type is the job's ending or a side row."""
    kinds = {"view": "success", "click": "failure", "purchase": "image", "error": "error"}
    ending = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    events = A.table(spark, sf, "events")
    kind = F.explode(F.array_compact(F.array(F.when(F.col("event_type").isin("view", "click"), "start"),
                                             F.element_at(ending, F.col("event_type")))))
    return events.select(kind.alias("kind"), F.floor(F.col("value") * 1000).alias("duration"),
                         (F.col("event_id") % 25).alias("items"))


_SCRAPING = """SELECT count(*) FILTER (event_type IN ('view', 'click')) AS jobs_processed,
    count(*) FILTER (event_type = 'view') AS jobs_succeeded, count(*) FILTER (event_type = 'click') AS jobs_failed,
    CAST(sum(CAST(floor(value * 1000) AS BIGINT)) FILTER (event_type = 'view') AS BIGINT) AS total_scraping_time,
    CAST(sum(event_id % 25) FILTER (event_type = 'view') AS BIGINT) AS items_scraped,
    count(*) FILTER (event_type = 'purchase') AS images_processed, count(*) FILTER (event_type = 'error') AS errors_encountered
  FROM events"""


@query("scraping_metrics", views(
    """SELECT *, round(total_scraping_time * 1.0 / jobs_succeeded, 4) AS average_scraping_time,
    round(jobs_succeeded * 100.0 / jobs_processed, 4) AS success_rate, round(jobs_failed * 100.0 / jobs_processed, 4) AS error_rate
    FROM scraping""", scraping=_SCRAPING))
def scraping_metrics(spark, sf):
    rounded = {c: F.round(c, 4) for c in ("average_scraping_time", "success_rate", "error_rate")}
    return M.scraping_metrics(job_log(spark, sf)).withColumns(rounded)


@query("performance_report", views(
    """SELECT jobs_processed AS total_jobs, round(jobs_succeeded * 100.0 / jobs_processed, 4) AS success_rate,
      round(jobs_failed * 100.0 / jobs_processed, 4) AS error_rate,
      round(total_scraping_time * 1.0 / jobs_succeeded, 4) AS average_processing_time,
      round(items_scraped * 1.0 / jobs_processed, 4) AS items_per_job, round(images_processed * 1.0 / jobs_processed, 4) AS images_per_job,
      round(running * 100.0 / queued, 4) AS queue_efficiency, round(completed * 100.0 / (queued + running + completed), 4) AS completion_rate,
      array_to_string(list_filter([
        CASE WHEN jobs_succeeded * 100.0 / jobs_processed < 80 THEN 'Consider investigating frequent job failures' END,
        CASE WHEN total_scraping_time * 1.0 / jobs_succeeded > 30000 THEN 'Average processing time is high - consider optimizing scrapers' END,
        CASE WHEN failed > completed * 0.1 THEN 'High number of failed jobs - review error patterns' END], lambda t: t IS NOT NULL), '; ')
        AS recommendations
    FROM scraping, (SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running,
      count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM scrape_job)""",
    "scrape_job", scraping=_SCRAPING))
def performance_report(spark, sf):
    report = M.performance_report(M.scraping_metrics(job_log(spark, sf)), J.queue_totals(A.scrape_job(spark, sf)))
    rates = [c for c in report.columns if c not in ("total_jobs", "recommendations")]
    return report.withColumns({c: F.round(c, 4) for c in rates}).withColumn(
        "recommendations", F.array_join("recommendations", "; "))


@query("dashboard_health", views(
    """SELECT 'warning' AS memory, CASE WHEN rate < 10 THEN 'healthy' ELSE 'warning' END AS error_rate_check, 'healthy' AS queue,
    'healthy' AS worker, round(rate, 4) AS error_rate, 'warning' AS status
    FROM (SELECT jobs_failed * 100.0 / jobs_processed AS rate FROM scraping)""", scraping=_SCRAPING))
def dashboard_health(spark, sf):
    rows = M.dashboard_health(M.scraping_metrics(job_log(spark, sf)), F.lit(95.0), F.lit(True), F.lit(True))
    return rows.withColumn("error_rate", F.round("error_rate", 4))


# ---- cache --------------------------------------------------------------------------------------------------------

_STATS = """count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses,
  count(*) FILTER (outcome = 'stale') AS stale_hits, count(*) FILTER (outcome = 'error') AS errors,
  count(*) FILTER (outcome <> 'error') AS total_requests"""
_RATES = """coalesce(hits * 100.0 / nullif(total_requests, 0), 0) AS hit_rate,
  coalesce(stale_hits * 100.0 / nullif(total_requests, 0), 0) AS stale_rate,
  coalesce(errors * 100.0 / nullif(total_requests, 0), 0) AS error_rate"""
_RATE_NAMES = ("hit_rate", "stale_rate", "error_rate")
_SAMPLES = f"SELECT *, {_RATES} FROM (SELECT date_trunc('hour', ts) AS ts, {_STATS} FROM cache_access GROUP BY 1)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names or _RATE_NAMES})


def cache_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One sample of the cache statistics per hour."""
    return C.cache_stats(A.cache_access(spark, sf), F.date_trunc("hour", "ts").alias("ts"))


@query("cache_stats", views(
    f"""SELECT hits, misses, stale_hits, errors, total_requests, round(hit_rate, 4) AS hit_rate, round(stale_rate, 4) AS stale_rate,
    round(error_rate, 4) AS error_rate FROM (SELECT *, {_RATES} FROM (SELECT {_STATS} FROM cache_access))""", "cache_access"))
def cache_stats(spark, sf):
    return _rounded(C.cache_stats(A.cache_access(spark, sf)))


@query("cache_health", views(
    f"""SELECT key, CASE WHEN error_rate > 10 THEN 'unhealthy' WHEN error_rate > 5 OR (total_requests > 10 AND hit_rate < 30)
        OR stale_rate > 50 THEN 'degraded' ELSE 'healthy' END AS status,
      CAST((error_rate > 5)::INT + (total_requests > 10 AND hit_rate < 30)::INT + (stale_rate > 50)::INT AS INTEGER) AS issues,
      CASE WHEN error_rate > 10 THEN 'High error rate: ' WHEN error_rate > 5 THEN 'Elevated error rate: ' END
        || format('{{:.2f}}', round(error_rate, 2)) || '%' AS error_issue
    FROM (SELECT *, {_RATES} FROM (SELECT key, {_STATS} FROM cache_access GROUP BY key))""", "cache_access"))
def cache_health(spark, sf):
    rows = C.cache_health(C.cache_stats(A.cache_access(spark, sf), "key"))
    return rows.select("key", "status", F.size("issues").alias("issues"),
                       F.when(F.col("error_rate") > 5, F.get("issues", F.lit(0))).alias("error_issue"))


_TREND = """round(coalesce(avg({c}) FILTER (rn <= 10) - avg({c}) FILTER (rn > 10), 0), 4)"""


@query("cache_trend", views(
    f"""SELECT {_TREND.format(c='hit_rate')} AS hit_rate_trend, {_TREND.format(c='error_rate')} AS error_rate_trend,
      {_TREND.format(c='total_requests')} AS volume_trend
    FROM (SELECT *, row_number() OVER (ORDER BY ts DESC) AS rn FROM samples) WHERE rn <= 20""", "cache_access", samples=_SAMPLES))
def cache_trend(spark, sf):
    return _rounded(C.cache_trend(cache_samples(spark, sf)), "hit_rate_trend", "error_rate_trend", "volume_trend")


@query("cache_recent_100", views(
    f"""SELECT {_stamp_sql('ts', 'ts')}, hits, total_requests FROM samples ORDER BY samples.ts DESC LIMIT 100""",
    "cache_access", samples=_SAMPLES))
def cache_recent_100(spark, sf):
    return C.recent_samples(cache_samples(spark, sf)).select(_stamp("ts"), "hits", "total_requests")


@query("cache_recommendations", views(
    f"""SELECT round(hit_rate, 4) AS hit_rate, array_to_string(list_filter([
        CASE WHEN hit_rate < 50 THEN 'Consider increasing cache TTL values to improve hit rate' END,
        CASE WHEN stale_rate > 30 THEN 'High stale rate detected - consider more frequent cache warming' END,
        CASE WHEN error_rate > 5 THEN 'Investigate cache errors - check KV namespace configuration' END,
        CASE WHEN hit_trend < -10 THEN 'Hit rate is declining - review cache invalidation patterns' END,
        CASE WHEN error_trend > 5 THEN 'Error rate is increasing - check system health' END], lambda t: t IS NOT NULL), '; ') AS recommendations
    FROM (SELECT *, {_RATES} FROM (SELECT {_STATS} FROM cache_access)),
      (SELECT {_TREND.format(c='hit_rate')} AS hit_trend, {_TREND.format(c='error_rate')} AS error_trend
       FROM (SELECT *, row_number() OVER (ORDER BY ts DESC) AS rn FROM samples) WHERE rn <= 20)""", "cache_access", samples=_SAMPLES))
def cache_recommendations(spark, sf):
    rows = C.cache_recommendations(C.cache_stats(A.cache_access(spark, sf)), C.cache_trend(cache_samples(spark, sf)))
    return rows.select(F.round("hit_rate", 4).alias("hit_rate"), F.array_join("recommendations", "; ").alias("recommendations"))


def cache_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A cache snapshot: per user the last event as its entry, the key built from the user id."""
    last = A.table(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.col("ts").cast("timestamp")).alias("cached_at"), F.max_by("event_type", "ts").alias("kind"))
    u = F.col("user_id")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("navigation", "categories", "products", "product_detail")]),
                          (u % 4 + 1).cast("int"))
    text = u.cast("string")
    parameters = F.create_map(
        F.lit("id"), F.when(u % 4 == 3, text), F.lit("navId"), F.when(u % 8 == 1, text),
        F.lit("categoryId"), F.when(u % 8 == 2, F.concat(F.lit("c "), text)), F.lit("limit"), F.when(u % 4 == 2, "20"))
    endpoint = F.concat(F.lit("/api/"), F.element_at(
        F.array(*[F.lit(p) for p in ("navigation", "categories", "products", "products/1")]), (u % 4 + 1).cast("int")))
    return last.select(
        "user_id", keys.cache_key(prefix, parameters).alias("key"), "cached_at",
        keys.endpoint_ttl(endpoint).alias("ttl"),
        F.when(F.col("kind") == "error", "error").when(F.col("kind") == "signup", "pending").otherwise("success").alias("state"))


_ENTRIES = """SELECT user_id AS u, last_at AS cached_at, kind,
    'https://cache.example.com/' || CASE user_id % 4 WHEN 0 THEN 'navigation'
      WHEN 1 THEN 'categories' || CASE WHEN user_id % 8 = 1 THEN ':navId=' || user_id ELSE '' END
      WHEN 2 THEN 'products:' || CASE WHEN user_id % 8 = 2 THEN 'categoryId=c%20' || user_id || '&' ELSE '' END || 'limit=20'
      ELSE 'product_detail:id=' || user_id END AS key,
    CASE user_id % 4 WHEN 0 THEN 3600 WHEN 1 THEN 1800 WHEN 2 THEN 300 ELSE 120 END AS ttl
  FROM (SELECT user_id, max(ts) AS last_at, arg_max(event_type, ts) AS kind FROM events GROUP BY user_id)"""
# The snapshot is looked at a few hours before the end, so that all three classes occur.
_LOOK = "TIMESTAMP '2024-01-30 23:30:00'"
_AGE = f"((epoch_us({_LOOK}) // 1000) - (epoch_us(cached_at) // 1000))"
_CLASS = f"CASE WHEN {_AGE} <= ttl * 1000 THEN 'fresh' WHEN {_AGE} <= ttl * 3000 THEN 'stale' ELSE 'expired' END"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_entries(cache_entries(spark, sf), F.lit("2024-01-30 23:30:00").cast("timestamp"))


@query("cache_keys", views("SELECT u AS user_id, key, CAST(ttl AS INTEGER) AS ttl FROM entries", entries=_ENTRIES))
def cache_keys(spark, sf):
    return cache_entries(spark, sf).select("user_id", "key", "ttl")


@query("ttl_settings", """SELECT event_id, CAST(coalesce(TRY_CAST(regexp_extract(text, '^\\s*([+-]?\\d+)', 1) AS INTEGER), 300) AS INTEGER)
  AS ttl FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'none' WHEN 'click' THEN '' ELSE
    json_extract_string(props, '$.k') || 's' END AS text FROM events)""")
def ttl_settings(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "error", "none").when(kind == "click", "").otherwise(
        F.concat(R.json_field(F.col("props"), "$.k", "string"), F.lit("s")))
    return A.table(spark, sf, "events").select("event_id", keys.ttl_setting(text, 300).alias("ttl"))


@query("freshness_class", views(f"SELECT u AS user_id, {_CLASS} AS freshness FROM entries", entries=_ENTRIES))
def freshness_class(spark, sf):
    return _classified(spark, sf).select("user_id", "freshness")


@query("freshness_counts", views(
    f"""SELECT count(*) AS total, count(*) FILTER (class <> 'fresh') AS stale, count(*) FILTER (kind = 'signup') AS pending,
      count(*) FILTER (kind = 'error') AS error, count(*) FILTER (kind NOT IN ('signup', 'error')) AS success
    FROM (SELECT kind, {_CLASS} AS class FROM entries)""", entries=_ENTRIES))
def freshness_counts(spark, sf):
    return C.freshness_counts(_classified(spark, sf))


_TARGET = f"""CASE u % 4 WHEN 0 THEN '{SITE}' WHEN 1 THEN CASE WHEN u % 8 = 1 THEN '{SITE}/category/' || u ELSE '{SITE}/categories' END
  WHEN 2 THEN CASE WHEN u % 8 = 2 THEN '{SITE}/category/c ' || u || '/products' ELSE '{SITE}/products' END
  ELSE '{SITE}/product/' || u END"""


@query("refresh_plan", views(
    f"""SELECT CASE u % 4 WHEN 0 THEN 'navigation' WHEN 1 THEN 'category' ELSE 'product' END AS type, {_TARGET} AS target_url,
      CAST(3 AS INTEGER) AS priority, count(DISTINCT key) AS keys FROM entries WHERE {_AGE} > ttl * 1000 GROUP BY ALL""", entries=_ENTRIES))
def refresh_plan(spark, sf):
    """Every entry past its time, expired ones too."""
    requests = C.refresh_requests(_classified(spark, sf), SITE, expired=True)
    return requests.groupBy("type", "target_url", "priority").agg(F.count_distinct("seq").alias("keys"))


@query("refresh_manual", views(
    f"""SELECT CASE u % 4 WHEN 0 THEN 'navigation' WHEN 1 THEN 'category' ELSE 'product' END AS type, {_TARGET} AS target_url,
      CAST(7 AS INTEGER) AS priority, 'manual' AS asked, count(DISTINCT key) AS keys FROM entries GROUP BY ALL""", entries=_ENTRIES))
def refresh_manual(spark, sf):
    """Every entry asked for by hand, fresh ones too: before the scheduled ones in the queue."""
    requests = C.refresh_requests(_classified(spark, sf), SITE, manual=True)
    return requests.groupBy("type", "target_url", "priority", F.col("metadata")["revalidation_type"].alias("asked")).agg(F.count_distinct("seq").alias("keys"))


@query("refresh_enqueue", views(
    f"""SELECT r.type, url AS target_url, CASE WHEN o.id IS NULL THEN 'insert' ELSE 'raise' END AS action,
      CAST(greatest(3, coalesce(o.priority, 0)) AS INTEGER) AS priority FROM (
      SELECT DISTINCT CASE u % 4 WHEN 0 THEN 'navigation' WHEN 1 THEN 'category' ELSE 'product' END AS type, {_TARGET} AS url
      FROM entries WHERE {_AGE} > ttl * 1000) r LEFT JOIN open_jobs o ON o.type = r.type AND o.target_url = r.url""",
    "scrape_job", entries=_ENTRIES, open_jobs=OPEN_JOBS_SQL))
def refresh_enqueue(spark, sf):
    changes = J.enqueue(A.scrape_job(spark, sf), C.refresh_requests(_classified(spark, sf), SITE, expired=True))
    return changes.select("type", "target_url", "action", "priority")


@query("refresh_callback", views(f"SELECT key, 'user' AS source FROM entries WHERE {_CLASS} = 'stale'", entries=_ENTRIES))
def refresh_callback(spark, sf):
    return C.refresh_requests(_classified(spark, sf), SITE,
                              trigger=lambda stale: stale.select("key", F.lit("user").alias("source")))


@query("invalidation_fanout", views(
    """SELECT key FROM entries WHERE (u % 4 = 3 AND u % 5 = 0) OR u % 4 IN (1, 2) GROUP BY key""", entries=_ENTRIES))
def invalidation_fanout(spark, sf):
    """Category changes from the nations, product changes from the users divisible by five: the first drop all category
    lists, the second all product lists and the details of their products."""
    nation = A.table(spark, sf, "nation").select(
        F.lit("category").alias("type"), F.concat(F.lit("c "), F.col("n_nationkey").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("category_id"))
    users = A.table(spark, sf, "events").filter("user_id % 5 = 0").select(
        F.lit("product").alias("type"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("category_id"))
    targets = C.invalidated_targets(nation.unionByName(users.distinct()))
    return C.invalidated_keys(cache_entries(spark, sf).select("key"), targets)


@query("invalidation_by_value", views(
    """SELECT key FROM entries WHERE u % 8 = 2 AND ('c ' || u) IN (SELECT 'c ' || n_nationkey FROM nation) GROUP BY key""",
    entries=_ENTRIES))
def invalidation_by_value(spark, sf):
    """The keys that one category's product list is stored under, for each nation as a category."""
    targets = A.table(spark, sf, "nation").select(
        F.lit("products").alias("prefix"), F.lit("categoryId").alias("parameter"),
        F.concat(F.lit("c "), F.col("n_nationkey").cast("string")).alias("value"))
    return C.invalidated_keys(cache_entries(spark, sf).select("key"), targets)


@query("invalidation_targets", """SELECT DISTINCT prefix, parameter, value FROM (
    SELECT unnest(CASE event_type
      WHEN 'view' THEN [{'prefix': 'navigation', 'parameter': NULL, 'value': NULL}, {'prefix': 'categories', 'parameter': NULL, 'value': NULL}]
      WHEN 'click' THEN [{'prefix': 'categories', 'parameter': NULL, 'value': NULL}, {'prefix': 'products', 'parameter': 'categoryId', 'value': CAST(user_id AS VARCHAR)},
                         {'prefix': 'navigation', 'parameter': NULL, 'value': NULL}]
      WHEN 'purchase' THEN [{'prefix': 'product_detail', 'parameter': 'id', 'value': CAST(user_id AS VARCHAR)},
                         {'prefix': 'products', 'parameter': 'categoryId', 'value': 'p'}, {'prefix': 'products', 'parameter': NULL, 'value': NULL}]
      ELSE [{'prefix': 'navigation', 'parameter': NULL, 'value': NULL}, {'prefix': 'categories', 'parameter': NULL, 'value': NULL},
            {'prefix': 'products', 'parameter': NULL, 'value': NULL}, {'prefix': 'product_detail', 'parameter': NULL, 'value': NULL}] END, recursive := true)
    FROM events)""")
def invalidation_targets(spark, sf):
    kind = F.col("event_type")
    changes = A.table(spark, sf, "events").select(
        F.when(kind == "view", "navigation").when(kind == "click", "category").when(kind == "purchase", "product")
        .otherwise("all").alias("type"), F.col("user_id").cast("string").alias("id"), F.lit("p").alias("category_id"))
    return C.invalidated_targets(changes)


@query("refresh_metrics", f"""SELECT count(*) FILTER (event_type <> 'error') AS total_requests,
    count(*) FILTER (event_type IN ('view', 'purchase')) AS successful_requests,
    count(*) FILTER (event_type IN ('click', 'signup')) AS failed_requests, count(*) FILTER (event_type = 'error') AS rate_limited_requests,
    round(avg(value) FILTER (event_type <> 'error'), 8) AS average_response_time, {_stamp_sql('max(ts)', 'last_request_time')},
    CAST(round(count(*) FILTER (event_type IN ('view', 'purchase')) * 100.0 / count(*) FILTER (event_type <> 'error')) AS INTEGER) AS success_rate
  FROM events""")
def refresh_metrics(spark, sf):
    kind = F.col("event_type")
    log = A.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration"),
        F.when(kind.isin("view", "purchase"), "success").when(kind == "error", "limited").otherwise("failure").alias("outcome"))
    rows = C.refresh_metrics(log)
    return rows.withColumn("average_response_time", F.round("average_response_time", 8)).withColumn(
        "last_request_time", F.date_format("last_request_time", "yyyy-MM-dd HH:mm:ss"))


@query("running_mean", """SELECT event_id, running_count, running_sum / running_count AS running_mean FROM (
  SELECT event_id, count(*) OVER w AS running_count, round(sum(value) OVER w, 2) AS running_sum FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def running_mean(spark, sf):
    events = A.table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    totals = T.running_totals(events, "event_type", ["ts", "event_id"], F.date_trunc("minute", "ts"), "value")
    return totals.select("event_id", "running_count",
                         (F.round("running_sum", 2) / F.col("running_count")).alias("running_mean"))


# ---- clickstream ------------------------------------------------------------------------------------------------------

@query("json_column", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_column(spark, sf):
    props = F.col("props")
    return A.table(spark, sf, "events").select(
        "event_id", R.json_field(props, "$.k", "int").alias("k"), F.element_at(R.json_map(props), "other").alias("missing"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Analytics batches of at most ten events of a session, and a timing per event that is not an error."""
    events = A.clickstream(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 10))
    event = F.struct(F.col("event"), F.lit("interaction").alias("category"), F.col("props").alias("properties"),
                     F.col("ts").alias("timestamp"), F.col("session_id").alias("sessionId"), F.col("user_id").cast("string").alias("userId"))
    metric = F.struct(F.when(F.col("event") == "view", "page_load").otherwise("api_call").alias("name"), F.col("value"),
                      F.lit("ms").alias("unit"), F.col("ts").alias("timestamp"),
                      F.create_map(F.lit("type"), F.col("event")).alias("metadata"))
    return events.groupBy("session_id", "user_id", "batch").agg(
        F.collect_list(event).alias("events"),
        F.collect_list(F.when(F.col("event") != "error", metric)).alias("performanceMetrics")).select(
        F.when(F.col("user_id") % 10 > 0, F.col("session_id")).alias("sessionId"), F.col("user_id").cast("string").alias("userId"),
        F.when(F.col("user_id") % 10 != 1, F.col("events")).alias("events"), "performanceMetrics")


@query("payload_explode", """SELECT 'event' AS kind, event_type AS name, count(*) AS n FROM events WHERE user_id % 10 > 1 GROUP BY ALL
  UNION ALL SELECT 'metric', CASE WHEN event_type = 'view' THEN 'page_load' ELSE 'api_call' END, count(*) FROM events
    WHERE user_id % 10 > 1 AND event_type <> 'error' GROUP BY ALL
  UNION ALL SELECT 'refused', 'payload', count(DISTINCT (user_id, date_trunc('day', ts), event_id // 10)) FROM events WHERE user_id % 10 <= 1""")
def payload_explode(spark, sf):
    """Payloads written as JSON lines, scanned with their schema, guarded and exploded."""
    path = scratch_path(spark, "payloads")
    payloads(spark, sf).write.json(path)
    stored = R.read_payloads(spark, path)
    good, bad = stored.filter(V.payload_ok()), stored.filter(~V.payload_ok())
    count = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return (count(M.payload_events(good), "event", F.col("event"))
            .unionByName(count(M.payload_metrics(good), "metric", F.col("name")))
            .unionByName(count(bad, "refused", F.lit("payload"))))


@query("analytics_summary", views(
    """SELECT count(*) AS total_sessions, CAST(sum(views) AS BIGINT) AS total_page_views, CAST(sum(n) AS BIGINT) AS total_events,
      round(avg(length_ms), 6) AS average_session_ms, round(sum(view_value) / sum(views), 8) AS average_page_load,
      round(sum(click_value) / sum(clicks), 8) AS average_api_response, round(sum(errors) * 100.0 / sum(n), 4) AS error_rate
    FROM (SELECT session_id, count(*) AS n, count(*) FILTER (event = 'view') AS views, count(*) FILTER (event = 'click') AS clicks,
        count(*) FILTER (event = 'error') AS errors, max(ts_ms) - min(ts_ms) AS length_ms,
        sum(value) FILTER (event = 'view') AS view_value, sum(value) FILTER (event = 'click') AS click_value
      FROM clickstream WHERE ts > TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY session_id)""",
    "clickstream"))
def analytics_summary(spark, sf):
    rows = M.analytics_summary(A.clickstream(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"))
    digits = {"average_session_ms": 6, "average_page_load": 8, "average_api_response": 8, "error_rate": 4}
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("analytics_top", views(
    """SELECT * FROM (SELECT 'event' AS kind, event AS name, count(*) AS count FROM recent GROUP BY event ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'page', page, count(*) FROM recent WHERE event = 'view' GROUP BY page ORDER BY 3 DESC, 2 LIMIT 10)""",
    "clickstream", recent="""SELECT event, '/p/' || (ts_ms // 1000) % 50 AS page FROM clickstream
      WHERE ts > TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00'"""))
def analytics_top(spark, sf):
    clicks, moment = A.clickstream(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp")
    viewed = clicks.withColumn("page", F.when(F.col("event") == "view", F.concat(
        F.lit("/p/"), (F.floor(F.col("ts_ms") / 1000) % 50).cast("string"))))
    events = M.analytics_top(clicks, moment, "event").select(F.lit("event").alias("kind"), F.col("event").alias("name"), "count")
    return events.unionByName(M.analytics_top(viewed, moment, "page").select(
        F.lit("page").alias("kind"), F.col("page").alias("name"), "count"))


@query("session_summary", views(
    """SELECT session_id, CAST(sum(n) AS BIGINT) AS events, max(last_ms) - CAST(split_part(session_id, '-', 1) AS BIGINT) AS duration_ms,
      string_agg(event || ':' || n, ',' ORDER BY n DESC, event) FILTER (rn <= 5) AS top_events, CAST(sum(timed) AS BIGINT) AS metrics
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, event) AS rn FROM (
      SELECT session_id, event, count(*) AS n, max(ts_ms) AS last_ms, count(*) FILTER (event <> 'error') AS timed
      FROM clickstream GROUP BY session_id, event)) GROUP BY session_id""", "clickstream"))
def session_summary(spark, sf):
    clicks = A.clickstream(spark, sf)
    rows = M.session_summary(clicks, clicks.filter("event <> 'error'").select("session_id"))
    top = F.transform("top_events", lambda e: F.concat(e["event"], F.lit(":"), e["n"].cast("string")))
    return rows.select("session_id", "events", "duration_ms", F.array_join(top, ",").alias("top_events"), "metrics")


@query("session_starts", views(
    f"""SELECT session_id, CAST(split_part(session_id, '-', 1) AS BIGINT) AS start_ms FROM clickstream GROUP BY session_id""",
    "clickstream"))
def session_starts(spark, sf):
    ids = A.clickstream(spark, sf).select("session_id").distinct()
    return ids.select("session_id", K.session_start_ms(F.col("session_id")).alias("start_ms"))


@query("metric_rollup", views(
    """SELECT event AS name, kind, count(*) AS n, round(avg(value), 8) AS avg_value, max(value) AS max_value, min(value) AS min_value
    FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 'script' WHEN 1 THEN 'stylesheet' WHEN 2 THEN 'image' WHEN 3 THEN 'api' ELSE 'other' END
      AS kind FROM clickstream) GROUP BY event, kind""", "clickstream"))
def metric_rollup(spark, sf):
    rows = resource_urls(A.clickstream(spark, sf)).withColumn("kind", K.resource_type(F.col("resource"))).withColumnRenamed("event", "name")
    return M.metric_rollup(rows, "name", "kind").withColumn("avg_value", F.round("avg_value", 8))


_CALLS = """SELECT event_type AS endpoint, CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CAST(CASE WHEN event_id % 20 = 0 THEN 500 ELSE 200 END AS INTEGER) AS status, user_id % 2 = 0 AS cached, date_trunc('week', ts) AS week, value FROM events"""


@query("metric_percentiles", f"""SELECT endpoint, method, status, cached, {_stamp_sql('week', 'week')}, count(value) AS n, min(value) AS min_value, max(value) AS max_value,
  true AS p50_close, true AS p95_close FROM ({_CALLS}) GROUP BY endpoint, method, status, cached, week""")
def metric_percentiles(spark, sf):
    """API calls by endpoint, method, status and cache use: hourly sketches merged by week; their p50 and p95 against the
    exact ranks of those values, which may be off by 0.03."""
    by = ["endpoint", "method", "status", "cached"]
    u, ts = F.col("user_id"), F.col("ts").cast("timestamp")
    calls = A.table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"), F.when(u % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_id") % 20 == 0, 500).otherwise(200).alias("status"), (u % 2 == 0).alias("cached"), ts.alias("ts"), "value")
    hourly = M.percentile_sketches(calls, by)
    weekly = M.merge_sketches(hourly.withColumn("week", F.date_trunc("week", "window_start")), [*by, "week"])
    shares = {"p50": 0.5, "p95": 0.95}
    found = M.percentiles(weekly, shares)
    rows = calls.withColumn("week", F.date_trunc("week", "ts")).join(found.select(*by, "week", *shares), [*by, "week"])
    exact = rows.groupBy(*by, "week").agg(*[c for p in shares for c in (
        F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_below"), F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_upto"))])
    close = {f"{p}_close": (F.col(f"{p}_below") <= share + 0.03) & (F.col(f"{p}_upto") >= share - 0.03) for p, share in shares.items()}
    return found.join(exact, [*by, "week"]).withColumns(close).select(*by, _stamp("week"), "n", "min_value", "max_value", *close)


def resource_urls(clicks: DataFrame) -> DataFrame:
    paths = F.array(*[F.lit(p) for p in ("/a/app.js?v=1", "/a/site.css", "/i/logo.png", "/api/products", "/page")])
    return clicks.withColumn("resource", F.element_at(paths, (F.col("user_id") % 5 + 1).cast("int")))


@query("resource_type", """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'script' WHEN 1 THEN 'stylesheet' WHEN 2 THEN 'image'
  WHEN 3 THEN 'api' ELSE 'other' END AS type FROM events""")
def resource_type(spark, sf):
    return resource_urls(A.clickstream(spark, sf)).select("event_id", K.resource_type(F.col("resource")).alias("type"))


@query("error_class", """SELECT event_id, event_type IN ('view', 'click', 'error') AS retryable,
  CASE event_type WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'crash' ELSE 'other' END AS kind,
  CASE WHEN user_id % 5 >= 3 THEN 'critical' WHEN event_type = 'view' THEN 'error' END AS severity FROM events""")
def error_class(spark, sf):
    kind = F.col("event_type")
    message = (F.when(kind == "view", "navigation timeout of 30000 ms").when(kind == "click", "Target closed")
               .when(kind == "error", "Network changed").otherwise("bad data"))
    return A.table(spark, sf, "events").select(
        "event_id", K.is_retryable(message).alias("retryable"), K.error_kind(message).alias("kind"),
        K.failure_severity(F.col("user_id") % 5, message).alias("severity"))


@query("is_mobile", """SELECT event_id, user_id % 3 = 0 OR event_id % 4 = 0 AS mobile, 'q' || lower(event_type) AS query,
  CAST(length(event_type) + 1 AS INTEGER) AS query_length FROM events""")
def is_mobile(spark, sf):
    agent = F.when(F.col("user_id") % 3 == 0, "Mozilla/5.0 (iPhone)").otherwise("Mozilla/5.0 (X11)")
    width = F.when(F.col("event_id") % 4 == 0, 700).otherwise(1200)
    search = X.search_properties(F.concat(F.lit("Q"), F.upper("event_type")))
    return A.table(spark, sf, "events").select("event_id", K.is_mobile(agent, width).alias("mobile"), search["query"].alias("query"),
                                               search["query_length"].alias("query_length"))


@query("top_events", "SELECT event_type AS event, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, event LIMIT 5")
def top_events(spark, sf):
    return M.top_k(A.clickstream(spark, sf), "event", 5)


def history_samples(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return A.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("processed"),
        (kind != "error").cast("int").alias("succeeded"), (kind == "error").cast("int").alias("failed"), F.col("value").alias("memory"))


_HISTORY = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) AS jobs, count(*) FILTER (event_type <> 'error') AS ok,
  count(*) FILTER (event_type = 'error') AS bad, max(value) AS peak FROM events GROUP BY 1"""


@query("metrics_history", views(
    f"""SELECT {_stamp_sql('w', 'window_start')}, jobs AS points, jobs, round(ok * 100.0 / jobs, 4) AS success_rate,
    round(bad * 100.0 / jobs, 4) AS error_rate, peak AS peak_memory FROM history""", history=_HISTORY))
def metrics_history(spark, sf):
    rows = M.metrics_history(history_samples(spark, sf), "5 minutes")
    return rows.select(_stamp("window_start"), "points", "jobs", F.round("success_rate", 4).alias("success_rate"),
                       F.round("error_rate", 4).alias("error_rate"), "peak_memory")


@query("metrics_history_summary", views(
    """SELECT count(*) AS data_points, round(avg(ok * 100.0 / jobs), 4) AS average_success_rate,
    round(avg(bad * 100.0 / jobs), 4) AS average_error_rate, max(peak) AS peak_memory, CAST(sum(jobs) AS BIGINT) AS total_jobs FROM history""",
    history=_HISTORY))
def metrics_history_summary(spark, sf):
    rows = M.history_summary(M.metrics_history(history_samples(spark, sf), "5 minutes"))
    return rows.withColumns({c: F.round(c, 4) for c in ("average_success_rate", "average_error_rate")})


_WINDOWS = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) AS errors, max(ts) AS last_seen FROM events
  WHERE event_type = 'error' GROUP BY 1"""


@query("error_windows", views(
    f"""SELECT {_stamp_sql('w', 'window_start')}, {_stamp_sql('w + INTERVAL 5 MINUTE', 'window_end')}, errors, errors > 1 AS alert,
      round(coalesce(errors * 300.0 / nullif(least(CAST(300 AS DOUBLE), ((epoch_us(last_seen) // 1000) - (epoch_us(w) // 1000)) / 1000.0), 0), 0), 3) AS projected_rate
    FROM windows""", windows=_WINDOWS))
def error_windows(spark, sf):
    rows = M.error_windows(A.log(spark, sf), threshold=1)
    return rows.select(_stamp("window_start"), _stamp("window_end"), "errors", "alert",
                       F.round("projected_rate", 3).alias("projected_rate"))


@query("sessions_gap", views(
    """SELECT user_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS events FROM (
      SELECT *, sum(CASE WHEN ts_ms - previous < 7200000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS no
      FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS previous FROM clickstream))
    GROUP BY user_id, no""", "clickstream"))
def sessions_gap(spark, sf):
    rows = T.gap_sessions(A.clickstream(spark, sf), "user_id", "ts_ms", 7_200_000)
    return rows.select("user_id", "start_ms", "end_ms", "events")


# ---- exports --------------------------------------------------------------------------------------------------------------

@query("export_roundtrip", views(
    f"""SELECT kind, level, component, message, count(*) AS n FROM (
      SELECT 'json' AS kind, * FROM (SELECT * FROM log WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY timestamp, event_id LIMIT 10000)
      UNION ALL SELECT 'csv', * FROM (SELECT * FROM log WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY timestamp, event_id LIMIT 10000))
    GROUP BY ALL""", "log"))
def export_roundtrip(spark, sf):
    """A log export in both formats, read back; messages get a quote and a comma to test the escaping."""
    logs = A.log(spark, sf).withColumn("message", F.concat(F.lit('a "quoted", '), "message"))
    folder, start = scratch_path(spark, "export"), F.lit("2024-01-10 00:00:00").cast("timestamp")
    as_json = exports.export_logs(logs, folder, "json", "2024-01-31", start=start)
    as_csv = exports.export_logs(logs, folder, "csv", "2024-01-31", start=start)
    columns = "timestamp timestamp, level string, component string, message string, metadata string"
    rows = spark.read.schema(columns).json(as_json).withColumn("kind", F.lit("json")).unionByName(
        spark.read.schema(columns).option("header", True).option("escape", '"').csv(as_csv).withColumn("kind", F.lit("csv")))
    plain = rows.withColumn("message", F.replace("message", F.lit('a "quoted", '), F.lit("")))
    return plain.groupBy("kind", "level", "component", "message").agg(F.count(F.lit(1)).alias("n"))


@query("export_table_csv", views(
    """SELECT id, title, CAST(price AS DOUBLE) AS price, CAST(len(image_urls) AS INTEGER) AS images FROM product""", "product"))
def export_table_csv(spark, sf):
    path = scratch_path(spark, "products-csv")
    exports.export_csv(A.product(spark, sf).select("id", "title", "price", "image_urls"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("id", "title", F.col("price").cast("double").alias("price"),
                       F.size(F.from_json("image_urls", "array<string>")).alias("images"))

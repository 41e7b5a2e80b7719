"""Cache accounting: hit statistics, health, trends, freshness classes, refresh and invalidation plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import STALE_FACTOR, freshness, key_prefix, refresh_job
from ..functions.text import merge_maps

STALE_PRIORITY, MANUAL_PRIORITY = 3, 7
HISTORY_SIZE, TREND_SIZE = 100, 10


def _rate(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0))


def cache_stats(accesses: DataFrame, *by: str | Column) -> DataFrame:
    """hits, misses, stale hits, errors and their rates; errors are not part of the total."""
    kinds = {"hits": "hit", "misses": "miss", "stale_hits": "stale", "errors": "error"}
    counts = [F.count_if(F.col("outcome") == outcome).alias(name) for name, outcome in kinds.items()]
    grouped = accesses.groupBy(*by).agg(*counts) if by else accesses.agg(*counts)
    total = F.col("hits") + F.col("misses") + F.col("stale_hits")
    return (grouped.withColumn("total_requests", total)
            .withColumn("hit_rate", _rate(F.col("hits"), F.col("total_requests")))
            .withColumn("stale_rate", _rate(F.col("stale_hits"), F.col("total_requests")))
            .withColumn("error_rate", _rate(F.col("errors"), F.col("total_requests"))))


def _percent(rate: Column) -> Column:
    return F.concat(F.format_string("%.2f", rate), F.lit("%"))


def cache_health(stats: DataFrame) -> DataFrame:
    """healthy, degraded or unhealthy, with the list of issues."""
    errors, hits, stale = F.col("error_rate"), F.col("hit_rate"), F.col("stale_rate")
    low_hits = (F.col("total_requests") > 10) & (hits < 30)
    issues = F.array_compact(F.array(
        F.when(errors > 10, F.concat(F.lit("High error rate: "), _percent(errors)))
        .when(errors > 5, F.concat(F.lit("Elevated error rate: "), _percent(errors))),
        F.when(low_hits, F.concat(F.lit("Low hit rate: "), _percent(hits))),
        F.when(stale > 50, F.concat(F.lit("High stale rate: "), _percent(stale)))))
    status = (F.when(errors > 10, "unhealthy").when((errors > 5) | low_hits | (stale > 50), "degraded")
              .otherwise("healthy"))
    return stats.withColumn("status", status).withColumn("issues", issues)


def recent_samples(samples: DataFrame, size: int = HISTORY_SIZE, ts: str = "ts") -> DataFrame:
    """The newest samples; a top-n, so nothing is ranked globally."""
    return samples.orderBy(F.col(ts).desc()).limit(size)


def cache_trend(samples: DataFrame, ts: str = "ts") -> DataFrame:
    """Mean of the last 10 samples minus mean of the 10 before, for hit %, error % and volume."""
    top = recent_samples(samples, 2 * TREND_SIZE, ts)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(F.col(ts).desc())))
    change = lambda c: F.coalesce(F.avg(F.when(F.col("rn") <= TREND_SIZE, F.col(c)))
                                  - F.avg(F.when(F.col("rn") > TREND_SIZE, F.col(c))), F.lit(0.0))
    return ranked.agg(change("hit_rate").alias("hit_rate_trend"), change("error_rate").alias("error_rate_trend"),
                      change("total_requests").alias("volume_trend"))


def cache_recommendations(stats: DataFrame, trend: DataFrame) -> DataFrame:
    """The current statistics (one row) with both trends and the texts of the rules that fire."""
    both = stats.withColumns({c: trend.select(c).scalar() for c in trend.columns})
    # The texts of the rules.
    rules = [
        (F.col("hit_rate") < 50, "Consider increasing cache TTL values to improve hit rate"),
        (F.col("stale_rate") > 30, "High stale rate detected - consider more frequent cache warming"),
        (F.col("error_rate") > 5, "Investigate cache errors - check KV namespace configuration"),
        (F.col("hit_rate_trend") < -10, "Hit rate is declining - review cache invalidation patterns"),
        (F.col("error_rate_trend") > 5, "Error rate is increasing - check system health"),
    ]
    return both.withColumn("recommendations", F.array_compact(F.array(*[F.when(c, t) for c, t in rules])))


def classify_entries(entries: DataFrame, as_of: Column, stale_factor: int = STALE_FACTOR) -> DataFrame:
    """Cache snapshot(key, cached_at, ttl) with its freshness class."""
    age = F.unix_millis(as_of) - F.unix_millis("cached_at")
    return entries.withColumn("freshness", freshness(age, F.col("ttl"), stale_factor))


def freshness_counts(classified: DataFrame) -> DataFrame:
    """total, stale, pending, error and success entries of a snapshot(state, freshness)."""
    return classified.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("freshness") != "fresh").alias("stale"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "error", "success")])


def refresh_requests(classified: DataFrame, site: str, priority: int | None = None,
                     trigger: Callable[[DataFrame], DataFrame] | None = None, manual: bool = False,
                     expired: bool = False) -> DataFrame:
    """One crawl request per stale key that maps to a job, or, asked for by hand, per key whatever its age, with a higher
    priority.  Expired keys are written anew when they are next read, unless `expired` asks for them too.  `trigger` may
    replace the rows' plan."""
    due = ["stale", "expired"] if expired else ["stale"]
    stale = classified if manual else classified.filter(F.col("freshness").isin(due))
    priority = priority or (MANUAL_PRIORITY if manual else STALE_PRIORITY)
    if trigger is not None:
        return trigger(stale)
    job = stale.withColumn("_job", refresh_job(F.col("key"), site)).filter(F.col("_job").isNotNull())
    extra = F.create_map(F.lit("cache_key"), F.col("key"), F.lit("revalidation_type"), F.lit("manual") if manual else F.col("freshness"))
    return job.select("_job.type", "_job.target_url", F.lit(priority).alias("priority"),
                      merge_maps(F.col("_job.metadata"), extra).alias("metadata"), F.col("key").alias("seq"))


def invalidated_targets(changes: DataFrame) -> DataFrame:
    """Change events(type, id, category_id) as (prefix, parameter, value) targets; null matches any."""
    target = lambda prefix, parameter=None, value=None: F.struct(
        F.lit(prefix).alias("prefix"), F.lit(parameter).cast("string").alias("parameter"),
        (F.lit(None).cast("string") if value is None else value).alias("value"))
    none = F.array(target("navigation")).cast("array<struct<prefix:string,parameter:string,value:string>>")
    empty = F.slice(none, 1, 0)
    kind, ident, cat = F.col("type"), F.col("id"), F.col("category_id")
    nav = F.array(target("navigation"), target("categories"))
    of_category = lambda value: F.array(target("products", "categoryId", value))
    plan = (
        F.when(kind == "navigation", nav)
        .when(kind == "category", F.concat(
            F.array(target("categories")), F.when(ident.isNotNull(), of_category(ident)).otherwise(empty),
            F.when(cat.isNotNull(), nav).otherwise(empty)))
        .when(kind == "product", F.concat(
            F.when(ident.isNotNull(), F.array(target("product_detail", "id", ident))).otherwise(empty),
            F.when(cat.isNotNull(), of_category(cat)).otherwise(empty), F.array(target("products"))))
        .when(kind == "all", F.array(*[target(p) for p in ("navigation", "categories", "products",
                                                           "product_detail")])))
    return changes.select(F.inline(plan)).distinct()


def invalidated_keys(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """Cache keys hit by any target: two equi-joins, on the prefix and on (prefix, parameter, value)."""
    parts = keys.withColumn("prefix", key_prefix(F.col("key")))
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract("key", r"^[^:]+://[^:]*:(.*)$", 1), "&"), lambda p: p != ""),
        lambda p: F.struct(F.split(p, "=", 2)[0].alias("parameter"),
                           F.try_url_decode(F.get(F.split(p, "=", 2), F.lit(1))).alias("value")))
    whole = targets.filter(F.col("parameter").isNull()).select("prefix").distinct()
    single = targets.filter(F.col("parameter").isNotNull()).select("prefix", "parameter", "value").distinct()
    by_prefix = parts.join(whole, "prefix", "left_semi").select("key")
    by_value = (parts.select("key", "prefix", F.inline(pairs))
                .join(single, ["prefix", "parameter", "value"], "left_semi").select("key"))
    return by_prefix.unionByName(by_value).distinct()


def refresh_metrics(triggers: DataFrame) -> DataFrame:
    """Trigger log(ts, outcome, duration): totals without the rate-limited ones, mean time, last request."""
    counted = F.col("outcome") != "limited"
    return triggers.agg(
        F.count_if(counted).alias("total_requests"),
        F.count_if(F.col("outcome") == "success").alias("successful_requests"),
        F.count_if(F.col("outcome") == "failure").alias("failed_requests"),
        F.count_if(~counted).alias("rate_limited_requests"),
        F.coalesce(F.avg(F.when(counted, F.col("duration"))), F.lit(0.0)).alias("average_response_time"),
        F.max("ts").alias("last_request_time"),
    ).withColumn("success_rate", F.round(_rate(F.col("successful_requests"), F.col("total_requests")), 0).cast("int"))

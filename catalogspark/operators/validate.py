"""Row validation: rule sets, error lists, good and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from .catalog import is_uuid

Rule = tuple[str, Column]  # message, condition that is true for a BAD row

URL_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(//[^\s/?#]+\S*|[^/\s]\S*)$"


def is_url(value: Column) -> Column:
    return value.rlike(URL_PATTERN)


def _too_short(name: str) -> Rule:
    return f"{name}: required", F.coalesce(F.length(name), F.lit(0)) < 1


def _longer(name: str, limit: int) -> Rule:
    return f"{name}: longer than {limit}", F.length(name) > limit


def _bad_url(name: str) -> Rule:
    return f"{name}: invalid url", ~F.coalesce(is_url(F.col(name)), F.lit(False))


def _bad_uuid(name: str) -> Rule:
    return f"{name}: invalid uuid", ~is_uuid(F.col(name))


def _not_in(name: str, values: list[str]) -> Rule:
    return f"{name}: not one of {', '.join(values)}", ~F.col(name).isin(values)


def _negative(name: str) -> Rule:
    return f"{name}: negative", F.col(name) < 0


def _image_urls() -> Rule:
    return "image_urls: invalid url", F.exists(F.coalesce("image_urls", F.array().cast("array<string>")),
                                               lambda u: ~F.coalesce(is_url(u), F.lit(False)))


def _product_core() -> list[Rule]:
    return [_too_short("title"), _bad_url("source_url"),
            ("price: not positive", F.col("price") <= 0),
            ("currency: not 3 letters", F.length(F.coalesce("currency", F.lit("GBP"))) != 3), _image_urls()]


def rules(name: str) -> list[Rule]:
    """The named rule sets.  `write_*` guard the tables, `strict_*` guard requests, `check_*` audit rows."""
    sets = {
        "write_navigation": lambda: [_too_short("title"), _bad_url("source_url"), _bad_uuid("parent_id")],
        "write_category": lambda: [_too_short("title"), _bad_url("source_url"), _bad_uuid("navigation_id"),
                                   _negative("product_count")],
        "write_product": lambda: _product_core() + [_bad_uuid("category_id")],
        "write_job": lambda: [_not_in("status", S.JOB_STATUSES), _negative("attempts")],
        "strict_navigation": lambda: [_too_short("title"), _longer("title", 200), _bad_url("source_url"),
                                      _bad_uuid("parent_id")],
        "strict_category": lambda: [_too_short("title"), _longer("title", 200), _bad_url("source_url"),
                                    _negative("product_count"), _bad_uuid("navigation_id")],
        "strict_product": lambda: [_too_short("title"), _longer("title", 500), *_product_core()[1:],
                                   _longer("summary", 2000), _bad_uuid("category_id")],
        "strict_job": lambda: [_not_in("type", S.JOB_TYPES), _bad_url("target_url"),
                               ("priority: not in 1..10", ~F.coalesce("priority", F.lit(5)).between(1, 10))],
        "check_product": lambda: [("check_price_positive", F.col("price") < 0),
                                  ("check_currency_valid", ~F.col("currency").isin(S.CURRENCIES)),
                                  ("check_image_urls_array", F.col("image_urls").isNull())],
        "check_job": lambda: [("check_type", ~F.col("type").isin(S.JOB_TYPES)),
                              ("check_status", ~F.col("status").isin(S.JOB_STATUSES))],
    }
    return sets[name]()


def check_images_json(column: str = "image_urls") -> Rule:
    """The array check for image urls still stored as JSON text."""
    return "check_image_urls_array", ~F.coalesce(
        F.schema_of_variant(F.try_parse_json(column)).startswith("ARRAY"), F.lit(False))


def with_errors(df: DataFrame, ruleset: list[Rule]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for message, bad in ruleset]))
    return df.withColumn("errors", found)


def first_error(df: DataFrame, ruleset: list[Rule]) -> DataFrame:
    return with_errors(df, ruleset).withColumn("error", F.get("errors", F.lit(0))).drop("errors")


def split_valid(df: DataFrame, ruleset: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with their errors.  Both read the same scan; nothing is lost."""
    checked = with_errors(df, ruleset)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def require_valid(df: DataFrame, ruleset: list[Rule]) -> DataFrame:
    """Fail the job on the first bad row (all-or-nothing batches).

    The check is a filter: no selection of columns, nor a mere count, can prune it away.
    """
    checked = with_errors(df, ruleset)
    stop = F.raise_error(F.concat(F.lit("validation failed: "), F.array_join("errors", ", "))).cast("boolean")
    return checked.filter(F.when(F.size("errors") == 0, F.lit(True)).otherwise(stop)).drop("errors")


def count_violations(df: DataFrame, ruleset: list[Rule]) -> DataFrame:
    """One row: bad rows per rule."""
    return df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(message) for message, bad in ruleset])


def payload_ok() -> Column:
    return (F.coalesce("sessionId", F.lit("")) != "") & F.col("events").isNotNull()


def within_tolerance(received_ms: Column, sent_ms: Column, window_ms: int = 300_000) -> Column:
    return F.abs(received_ms - sent_ms) <= window_ms

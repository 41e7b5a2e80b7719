"""Merging scraped rows and change sets into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..session import written

MERGE_MODES = ("overwrite", "overwrite_all", "fill_only")


# Decimal digits that hold a type's values, and what makes them positive.
_DIGITS = {"boolean": (1, 1), "tinyint": (3, 129), "smallint": (5, 32_769), "int": (10, 2**31 + 1), "date": (10, 2**31 + 1),
           "bigint": (20, 2**63 + 1), "timestamp": (20, 2**63 + 1)}
_WIDE = "decimal(38,0)"


def _rank(df: DataFrame, order: list[str], tie: Column) -> Column:
    """One value that orders rows by `order`, nulls first, and then by a hash.

    Numbers and times that fit go into a decimal, which a hash aggregate can hold; anything else is a struct.
    """
    kinds = dict(df.dtypes)
    if not all(kinds[c] in _DIGITS for c in order) or sum(_DIGITS[kinds[c]][0] for c in order) > 30:
        return F.struct(*order, tie)
    value, places = F.pmod(tie, F.lit(10**8)).cast(_WIDE), 8
    for name in reversed(order):
        digits, shift = _DIGITS[kinds[name]]
        number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kinds[name], lambda c: c.cast("bigint"))(F.col(name))
        number = F.coalesce(number.cast(_WIDE) + F.lit(str(shift)).cast(_WIDE), F.lit(0).cast(_WIDE))
        value, places = (number * F.lit(str(10**places)).cast(_WIDE) + value).cast(_WIDE), places + digits
    return value


def winners(rows: DataFrame, key: str, order: list[str], tie: Column, row_id: str = "_id") -> DataFrame:
    """The row ids of the last row of each key: only the key, the order and the id are aggregated, map-side first."""
    return rows.groupBy(key).agg(F.max_by(row_id, _rank(rows, order, tie)).alias(row_id)).select(row_id)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`; rows that tie go by a hash of all their columns.

    The rows are written once with an id; the winner of a key is found on narrow columns, so that copies of a hot key
    shrink before the shuffle, and its payload joined by the id.
    """
    rows = written(df.withColumn("_id", F.monotonically_increasing_id()), "latest")
    whole = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes]
    return rows.join(winners(rows, key, order, F.xxhash64(*whole)), "_id").drop("_id")


def upsert(target: DataFrame, source: DataFrame, table: str, as_of: Column, order: list[str],
           mode: str = "overwrite", key: str = "source_url") -> DataFrame:
    """Merge scraped rows by url; the result has the target's columns plus `action`.

    overwrite: values the source has win.  overwrite_all: every source column wins, nulls too.
    fill_only: the source only fills what the target lacks.  id and created_at never change.
    """
    if mode not in MERGE_MODES:
        raise ValueError(f"merge mode: {mode}")
    rows = latest_per_key(source.filter(F.col(key).isNotNull()), key, order)
    given = [c for c in target.columns if c in rows.columns and c not in (
        key, "id", "created_at", "updated_at", "last_scraped_at")]
    kinds = {f.name: f.dataType for f in target.schema}
    incoming = rows.select(key, *[F.col(c).cast(kinds[c]).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    incoming_all = incoming if mode == "fill_only" else _with_new_defaults(incoming, table, kinds)
    both = target.withColumn("_old", F.lit(True)).join(incoming_all, key, "full_outer")
    hit, old = F.col("_hit").isNotNull(), F.col("_old").isNotNull()

    def value(name: str) -> Column:
        current = F.col(name)
        if name == "id":
            return F.coalesce(current, S.row_id(F.col(key)))
        if name == "created_at":
            return F.coalesce(current, as_of)
        if name in ("updated_at", "last_scraped_at"):
            return F.when(hit, as_of).otherwise(current)
        if name == key or name not in given:
            return current
        new = F.col(f"_new_{name}")
        if mode == "overwrite":
            return F.coalesce(new, current)
        if mode == "overwrite_all":
            return F.when(hit, new).otherwise(current)
        return F.coalesce(current, new)

    action = F.when(hit & old, "update").when(hit, "insert").otherwise("keep")
    merged = both.select(*[value(c).alias(c) for c in target.columns], action.alias("action"))
    return S.with_defaults(merged, table)


def _with_new_defaults(incoming: DataFrame, table: str, kinds: dict) -> DataFrame:
    """Write defaults belong to the incoming row, so they overwrite the stored value."""
    names = [n for n in S.DEFAULTS[table] if f"_new_{n}" in incoming.columns]
    renamed = incoming.withColumnsRenamed({f"_new_{n}": n for n in names})
    return S.with_defaults(renamed, table).withColumnsRenamed({n: f"_new_{n}" for n in names})


def apply_changes(target: DataFrame, changes: DataFrame, key: str = "id", as_of: Column | None = None,
                  cleared: str | None = None) -> DataFrame:
    """Point updates as one join: non-null values of a change row replace the stored ones.

    `cleared` names a column of the changes that lists target columns to set to null.  With `as_of`, updated_at of each
    row that has a change row takes that moment.
    """
    changed = [c for c in changes.columns if c not in (key, cleared)]
    lists = F.col(cleared) if cleared else F.lit(None).cast("array<string>")
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], lists.alias("_cleared"), F.lit(True).alias("_hit"))

    def value(name: str) -> Column:
        if name == key:
            return F.col(name)
        if name == "updated_at" and as_of is not None:
            return F.when(F.col("_hit"), as_of).otherwise(F.col(name)).alias(name)
        kept = F.coalesce(F.col(f"_new_{name}"), F.col(name)) if name in changed else F.col(name)
        emptied = F.coalesce(F.array_contains("_cleared", name), F.lit(False)) if cleared else F.lit(False)
        return F.when(~emptied, kept).alias(name) if cleared else kept.alias(name)

    return target.join(new, key, "left").select(*[value(c) for c in target.columns])


def affected(rows: DataFrame, name: str = "affected") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def refresh_product_counts(categories: DataFrame, products: DataFrame) -> DataFrame:
    """category.product_count from the products; 0 where there are none."""
    counts = (products.filter(F.col("category_id").isNotNull()).groupBy(F.col("category_id").alias("id"))
              .agg(F.count(F.lit(1)).alias("_n")))
    return (categories.join(counts, "id", "left")
            .withColumn("product_count", F.coalesce("_n", F.lit(0)).cast("int")).drop("_n"))


def signed_changes(feed: DataFrame) -> DataFrame:
    """Change feed (op, old_category_id, new_category_id) as (category_id, delta) rows."""
    plus = F.when(F.col("op").isin("insert", "move"), F.struct(F.col("new_category_id").alias("category_id"),
                                                               F.lit(1).alias("delta")))
    minus = F.when(F.col("op").isin("delete", "move"), F.struct(F.col("old_category_id").alias("category_id"),
                                                                F.lit(-1).alias("delta")))
    return (feed.select(F.inline(F.array_compact(F.array(plus, minus))))
            .filter(F.col("category_id").isNotNull()))


def apply_count_changes(categories: DataFrame, feed: DataFrame) -> DataFrame:
    deltas = signed_changes(feed).groupBy(F.col("category_id").alias("id")).agg(F.sum("delta").alias("_d"))
    return (categories.join(deltas, "id", "left")
            .withColumn("product_count", (F.col("product_count") + F.coalesce("_d", F.lit(0))).cast("int")).drop("_d"))


def attach_category(listings: DataFrame, categories: DataFrame) -> DataFrame:
    """Give listing rows the id of the category whose url their page belongs to."""
    ids = categories.select(F.col("source_url").alias("category_url"), F.col("id").alias("category_id"))
    return listings.join(ids, "category_url", "left")

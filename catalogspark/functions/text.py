"""Text, price and label functions (Column in, Column out)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Currency signs of the price text and of the price label.
CURRENCY_OF_SIGN = {"£": "GBP", "$": "USD", "€": "EUR"}
LABEL_OF_CURRENCY = {"GBP": "£", "USD": "US$", "EUR": "€"}
SPEC_LABEL_ACRONYMS = ["Isbn", "Url", "Id", "Api"]

_BLANKS = r"(?U)[\s﻿]+"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function names it.

    Without it each mention would repeat the value's whole expression, in the plan and at run time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def clean_text(text: Column) -> Column:
    """Null gives '', ends are trimmed and each run of white space becomes one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "))


def first_match(text: Column, pattern: str, group: int) -> Column:
    """regexp_extract with null, not '', where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def price_of(text: Column, thousands: bool = False) -> Column:
    """First amount after a currency sign.  Thousands separators end the number unless asked for."""
    pattern = r"[£$€](\d[\d,]*\.?\d*)" if thousands else r"[£$€](\d+\.?\d*)"
    return F.regexp_replace(first_match(text, pattern, 1), ",", "").try_cast("double")


def currency_of(text: Column) -> Column:
    return F.element_at(_literal_map(CURRENCY_OF_SIGN), first_match(text, r"([£$€])\d", 1))


def spec_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "_")


def spec_pair(text: Column) -> Column:
    """'key: value' cut at the first colon; the value keeps later colons."""
    parts = F.split(text, ":", 2)
    return F.struct(spec_key(F.get(parts, F.lit(0))).alias("key"), trim_all(F.get(parts, F.lit(1))).alias("value"))


def item_count(text: Column) -> Column:
    return F.coalesce(first_match(text, r"(\d+)", 1).try_cast("int"), F.lit(0))


def is_available(text: Column) -> Column:
    return ~F.coalesce(F.lower(text).rlike("out of stock|unavailable"), F.lit(False))


def sanitize(text: Column) -> Column:
    return F.translate(trim_all(text), "<>", "")


def format_price(price: Column, currency: Column) -> Column:
    code = F.coalesce(currency, F.lit("GBP"))
    sign = F.coalesce(F.element_at(_literal_map(LABEL_OF_CURRENCY), code), F.concat(code, F.lit(" ")))
    minus = F.when(price < 0, "-").otherwise("")
    return (F.when(price.isNull(), "Price not available")
            .otherwise(F.concat(minus, sign, F.format_number(F.abs(price), 2))))


def _plural(number: Column, unit: str) -> Column:
    return F.concat(number.cast("string"), F.lit(f" {unit}"), F.when(number > 1, "s").otherwise(""), F.lit(" ago"))


def relative_time(moment: Column, as_of: Column) -> Column:
    seconds = F.floor((F.unix_millis(as_of) - F.unix_millis(moment)) / 1000)
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    return (F.when(seconds < 60, "Just now").when(minutes < 60, _plural(minutes, "minute"))
            .when(hours < 24, _plural(hours, "hour")).when(days < 7, _plural(days, "day"))
            .otherwise(F.date_format(moment, "dd/MM/yyyy")))


def truncate(text: Column, limit: int) -> Column:
    return (F.when(F.length(text) <= limit, text)
            .otherwise(F.concat(trim_all(F.substring(text, 1, limit)), F.lit("..."))))


def spec_label(key: Column) -> Column:
    """Underscores become spaces, words get a capital, known short words all capitals."""
    pieces = F.regexp_extract_all(F.replace(key, F.lit("_"), F.lit(" ")), F.lit(r"(\w+|\W+)"), F.lit(1))
    label = F.array_join(F.transform(
        pieces, lambda w: F.when(w.rlike(r"^\w"), F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
        .otherwise(w)), "")
    for word in SPEC_LABEL_ACRONYMS:
        label = F.replace(label, F.lit(word), F.lit(word.upper()))
    return label


def count_label(number: Column, noun: str = "product") -> Column:
    return F.concat(F.format_number(number, 0), F.lit(f" {noun}"), F.when(number == 1, "").otherwise("s"))


def search_properties(query: Column) -> Column:
    return F.struct(F.lower(query).alias("query"), F.length(query).alias("query_length"))


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; on equal keys the right side wins."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)

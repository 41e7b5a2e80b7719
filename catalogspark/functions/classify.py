"""Classes of urls, errors, devices and alerts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Error patterns worth a retry, device words, alert colours.
RETRYABLE = ["timeout", "network", "connection", "target closed", "browser closed", "page crashed",
             "navigation failed"]
CRASH = ["Target closed", "Browser closed", "Connection closed"]
MOBILE_WORDS = ["mobile", "android", "iphone", "ipad", "ipod", "blackberry", "windows phone"]
ALERT_COLOURS = {"critical": "#ff0000", "error": "#ff6600", "warning": "#ffcc00", "info": "#0066cc"}
OTHER_COLOUR = "#808080"
SMALL_VIEWPORT = 768
MAX_ATTEMPTS = 3


def resource_type(url: Column) -> Column:
    return (F.when(url.contains(".js"), "script").when(url.contains(".css"), "stylesheet")
            .when(url.rlike(r"\.(jpg|jpeg|png|gif|webp|svg)$"), "image")
            .when(url.contains("/api/"), "api").otherwise("other"))


def is_retryable(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)" + "|".join(RETRYABLE)), F.lit(False))


def error_kind(message: Column) -> Column:
    return (F.when(message.rlike("|".join(CRASH)), "crash").when(message.rlike("[Tt]imeout"), "timeout")
            .otherwise("other"))


def failure_severity(attempts: Column, message: Column) -> Column:
    """Severity of the alert a failed job raises; null when it raises none."""
    return (F.when(F.coalesce(attempts, F.lit(1)) >= MAX_ATTEMPTS, "critical")
            .when(message.contains("timeout"), "error"))


def is_mobile(agent: Column, width: Column) -> Column:
    return (F.coalesce(F.lower(agent).rlike("|".join(MOBILE_WORDS)), F.lit(False))
            | F.coalesce(width < SMALL_VIEWPORT, F.lit(False)))


def session_start_ms(session_id: Column) -> Column:
    return F.split(session_id, "-")[0].try_cast("bigint")


def alert_colour(level: Column) -> Column:
    colour = F.lit(OTHER_COLOUR)
    for name, code in ALERT_COLOURS.items():
        colour = F.when(level == name, F.lit(code)).otherwise(colour)
    return colour


def webhook_payload(level: Column, title: Column, message: Column, source: Column, timestamp: Column,
                    metadata: Column) -> Column:
    """The JSON text an alert hook would be sent; metadata entries become extra short fields."""
    field = lambda name, value, short: F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("title"), value.alias("value"),
        F.lit(short).alias("short"))
    own = F.array(field("Message", message, False), field("Source", source, True), field("Timestamp", timestamp, True))
    more = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: field(e["key"], e["value"], True))
    fields = F.concat(own, F.coalesce(more, F.slice(own, 1, 0)))
    return F.to_json(F.struct(
        F.concat(F.lit("🚨 "), F.upper(level), F.lit(": "), title).alias("text"),
        F.array(F.struct(alert_colour(level).alias("color"), fields.alias("fields"))).alias("attachments")))

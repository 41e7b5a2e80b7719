"""Table schemas, defaults and keys of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
STAMP, BOOL = T.TimestampType(), T.BooleanType()
STRINGS, STRING_MAP = T.ArrayType(STRING), T.MapType(STRING, STRING)
PRICE = T.DecimalType(10, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


NAVIGATION = _schema(
    id=STRING, title=STRING, source_url=STRING, parent_id=STRING,
    last_scraped_at=STAMP, created_at=STAMP, updated_at=STAMP,
)
CATEGORY = _schema(
    id=STRING, navigation_id=STRING, title=STRING, source_url=STRING, product_count=INT,
    last_scraped_at=STAMP, created_at=STAMP, updated_at=STAMP,
)
PRODUCT = _schema(
    id=STRING, category_id=STRING, title=STRING, source_url=STRING, source_id=STRING,
    price=PRICE, currency=STRING, image_urls=STRINGS, summary=STRING, specs=STRING_MAP,
    available=BOOL, last_scraped_at=STAMP, created_at=STAMP, updated_at=STAMP,
)
SCRAPE_JOB = _schema(
    id=STRING, type=STRING, target_url=STRING, status=STRING, attempts=INT, max_attempts=INT,
    last_error=STRING, metadata=STRING_MAP, priority=INT, locked_at=STAMP, locked_by=STRING,
    completed_at=STAMP, created_at=STAMP, updated_at=STAMP,
)
LOG = _schema(timestamp=STAMP, level=STRING, component=STRING, message=STRING, metadata=STRING_MAP)
HTTP_ACCESS = _schema(
    timestamp=STAMP, message=STRING, method=STRING, url=STRING, statusCode=INT, duration=LONG,
    contentLength=LONG,
)
CLICK_EVENT = _schema(
    event=STRING, category=STRING, properties=STRING, timestamp=STAMP, sessionId=STRING, userId=STRING,
)
PERFORMANCE_METRIC = _schema(name=STRING, value=DOUBLE, unit=STRING, timestamp=STAMP, metadata=STRING_MAP)
ANALYTICS_PAYLOAD = _schema(
    sessionId=STRING, userId=STRING, events=T.ArrayType(CLICK_EVENT),
    performanceMetrics=T.ArrayType(PERFORMANCE_METRIC), timestamp=STAMP, userAgent=STRING, url=STRING,
)

# The enumerations and column defaults of the stored tables.
JOB_TYPES = ["navigation", "category", "product"]
JOB_STATUSES = ["queued", "running", "completed", "failed"]
OPEN_STATUSES = ["queued", "running"]
TERMINAL_STATUSES = ["completed", "failed"]
CURRENCIES = ["GBP", "USD", "EUR"]
DEFAULTS = {
    "navigation": {},
    "category": {"product_count": 0},
    "product": {"currency": "GBP", "image_urls": [], "specs": {}, "available": True},
    "scrape_job": {"status": "queued", "attempts": 0, "max_attempts": 3, "metadata": {}, "priority": 0},
}


def _default(value: object, kind: T.DataType) -> Column:
    if isinstance(value, list):
        return F.array().cast(kind)
    if isinstance(value, dict):
        return F.create_map().cast(kind)
    return F.lit(value).cast(kind)


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the column defaults the stored table would give to missing values."""
    kinds = {field.name: field.dataType for field in df.schema}
    fills = {
        name: F.coalesce(F.col(name), _default(value, kinds[name]))
        for name, value in DEFAULTS[table].items()
        if name in kinds
    }
    return df.withColumns(fills) if fills else df


def row_id(source_url: Column) -> Column:
    """Deterministic id of a stored row, so that a retried task makes the same id."""
    return F.sha2(source_url, 256)

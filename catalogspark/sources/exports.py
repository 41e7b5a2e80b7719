"""Writers: tables, appends, CSV and log exports, published snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

LOG_EXPORT_LIMIT = 10_000
LOG_COLUMNS = ["timestamp", "level", "component", "message", "metadata"]


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns become JSON text, quotes are escaped by doubling."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
            for f in df.schema]
    df.select(*flat).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def log_export(logs: DataFrame, start: Column | None = None, end: Column | None = None,
               limit: int = LOG_EXPORT_LIMIT) -> DataFrame:
    """The rows of a log export: time-bounded, oldest first, at most `limit` of them."""
    if start is not None:
        logs = logs.filter(F.col("timestamp") >= start)
    if end is not None:
        logs = logs.filter(F.col("timestamp") <= end)
    order = ["timestamp"] + [c for c in ("event_id",) if c in logs.columns]
    return logs.orderBy(*order).limit(limit).select(*LOG_COLUMNS)


def export_logs(logs: DataFrame, folder: str, kind: str, day: str, **bounds) -> str:
    """Write a log export as JSON lines or CSV under a dated name; returns its path."""
    if kind not in ("json", "csv"):
        raise ValueError(f"Invalid format: {kind}. Supported formats: json, csv")
    rows, path = log_export(logs, **bounds), f"{folder.rstrip('/')}/logs-{day}.{kind}"
    if kind == "json":
        rows.write.json(path)
    else:
        export_csv(rows, path)
    return path


class Snapshots:
    """A table kept as immutable snapshot folders.  Readers follow the newest complete one.

    Publishing writes a new folder and never touches the one being read; Spark's own _SUCCESS file
    marks it complete, so a job that dies half-way publishes nothing.  A version number is given by
    the caller (a batch id, a run number), so a repeated attempt replaces its own folder.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.root}/v={version:012d}"

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/_SUCCESS"))
        return sorted(int(status.getPath().getParent().getName()[2:]) for status in done)

    def publish(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(version))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest snapshot (older than `before`), or None when there is none."""
        usable = [v for v in self.versions() if before is None or v < before]
        return self.at(usable[-1]) if usable else None

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._folder(version))


class BucketedTable:
    """A table in hash buckets of its key, of which a merge reads and writes only those that its rows fall into.

    A merge writes the touched buckets into a folder of its version and then, as one small snapshot, which version of each
    bucket is current; readers follow the newest such layout, so a job that dies half-way changes nothing.  Versions come
    from the caller, so a repeated attempt reads what lay before it and replaces its own folder.  The number of buckets is
    fixed for a table; a bucket should be a few hundred megabytes.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str = "source_url", buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.layouts = Snapshots(spark, f"{self.root}/layouts")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def layout(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that holds rows."""
        found = self.layouts.read(before)
        return {} if found is None else {r.bucket: r.version for r in found.collect()}

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.root}/data/v={version:012d}/_bucket={bucket}"

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        paths = [self._folder(v, b) for b, v in self.layout(before).items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: numbers below `buckets`, however many rows there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def replace(self, rows: DataFrame, touched: list[int], version: int) -> None:
        """Make rows the content of the touched buckets."""
        folder = f"{self.root}/data/v={version:012d}"
        dealt = rows.withColumn("_bucket", self.bucket()).repartition(max(1, len(touched)), "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        made = {int(s.getPath().getName()[8:]) for s in files.listStatus(path) if s.getPath().getName().startswith("_bucket=")}
        layout = {b: v for b, v in self.layout(version).items() if b not in touched} | {b: version for b in made}
        self.layouts.publish(self.spark.createDataFrame(sorted(layout.items()), "bucket int, version bigint").coalesce(1), version)

    def merge(self, rows: DataFrame, version: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of rows by how(their content before this version, rows); returns them."""
        touched = self.touched(rows)
        self.replace(how(self.read(version, touched), rows), touched, version)
        return touched

    def expire(self, keep: int = 2) -> list[str]:
        """Remove bucket folders of this table that none of the last `keep` layouts names; returns their paths.

        Readers that hold an older layout than those must have ended.
        """
        versions = self.layouts.versions()
        if len(versions) <= keep:
            return []
        named = {self._folder(v, b) for number in versions[-keep:] for b, v in self.layout(number + 1).items()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = []
        for version in versions[:-keep]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/v={version:012d}")
            for status in files.listStatus(folder) if files.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith("_bucket=") and self._folder(version, int(name[8:])) not in named:
                    files.delete(status.getPath(), True)
                    old.append(self._folder(version, int(name[8:])))
        return old

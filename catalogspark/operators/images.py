"""Image inventory: guards, header facts, manifest, and the way back to the products."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import urls as U
from ..session import tasks_for

MAX_BYTES = 5 * 1024 * 1024
FORMATS = ["jpeg", "jpg", "png", "webp", "gif"]


def _size_of(data: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height from the header of an image file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return ("webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return ("webp", *(v & 0x3FFF for v in struct.unpack("<HH", data[26:30])))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5:at + 9])
                return "jpeg", width, height
            at += 2 if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD8 else 2 + int.from_bytes(data[at + 2:at + 4], "big")
        return "jpeg", None, None
    return None, None, None


FACTS = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()),
                      T.StructField("height", T.IntegerType())])


@F.pandas_udf(FACTS)
def image_facts(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in content:
        facts = pd.DataFrame([_size_of(bytes(data)) for data in batch], columns=["format", "width", "height"])
        yield facts.astype({"width": "Int32", "height": "Int32"})


SHARDS = 1024           # folders that files are dealt into, each listed and read by one task
READ_BYTES = 4 << 20    # content of the files that are handed on together


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_blobs(blobs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Write each blob(name, content) as a file of a shared folder, by the tasks that have it; returns name and length.

    Files are dealt into numbered folders, for `scan_blobs`.  A file is named by its blob, so a repeated task writes it
    once more, the same.  The folder's scheme must be one that pyarrow knows.
    """
    def work(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        (store, root), made = _store(folder), set()
        for batch in batches:
            lengths = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                shard = zlib.crc32(name.encode()) % shards
                if shard not in made:
                    store.create_dir(f"{root}/{shard}", recursive=True)
                    made.add(shard)
                with store.open_output_stream(f"{root}/{shard}/{name}") as file:
                    file.write(content or b"")
                lengths.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(lengths, pa.int64())], names=["name", "length"])

    return blobs.select("name", "content").mapInArrow(work, "name string, length bigint")


def scan_blobs(spark, folder: str, max_bytes: int = MAX_BYTES, shards: int = SHARDS) -> DataFrame:
    """The files of `write_blobs` as url, length, content, like `read_blobs`, but listed by the tasks that read them.

    For files so many and small that neither the driver should list them nor a scan be planned file by file.
    """
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = _store(folder)
        schema = pa.schema([("url", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                rows, held = [], 0
                for file in store.get_file_info(fs.FileSelector(f"{root}/{shard}", allow_not_found=True)):
                    if not file.is_file or not file.size:
                        continue
                    content = None
                    if file.size <= max_bytes:
                        with store.open_input_stream(file.path) as data:
                            content = data.read()
                    rows.append((file.path, file.size, content))
                    held += len(content or b"")
                    if held >= READ_BYTES or len(rows) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.range(0, shards, 1, min(shards, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(
        work, "url string, length bigint, content binary")


def read_blobs(spark, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Image files as url, length, content; the url is the file's path.

    The file source skips empty files, so such an image ends like one that was not downloaded.  Files above the guard are
    listed without being read: the source takes the limit on the length as a filter.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= max_bytes).select(F.col("path").alias("url"), "length", "content")
    large = files.filter(F.col("length") > max_bytes).select(F.col("path").alias("url"), "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def inspect(blobs: DataFrame, public_url: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One result per blob(url, length, content): success, error, size, format, dimensions, object key.

    Size guards run before any content goes to Python; the bytes are dropped here, so the later join
    with the products moves only these facts.
    """
    guard = (F.when(F.col("length") == 0, "Empty image data received")
             .when(F.col("length") > max_bytes, F.format_string("Image too large: %d bytes (max: %d)", "length",
                                                                F.lit(max_bytes))))
    checked = blobs.withColumn("error", guard).withColumn(
        "facts", image_facts(F.when(F.col("error").isNull(), F.col("content")).otherwise(F.lit(b""))))
    fmt = F.col("facts.format")
    error = F.coalesce("error", F.when(fmt.isNull() | ~fmt.isin(FORMATS), "Unsupported format"))
    name = F.concat(F.sha2("content", 256), F.lit("."), fmt)
    return (checked.withColumn("error", error).select(
        "url", F.col("error").isNull().alias("success"), "error", F.col("length").alias("size"),
        fmt.alias("format"), F.struct("facts.width", "facts.height").alias("dimensions"),
        F.when(F.col("error").isNull(), F.concat(F.lit("products/"), name)).alias("object_key"))
        .withColumn("public_url", F.concat(F.lit(public_url.rstrip("/") + "/"), "object_key")))


def product_images(products: DataFrame) -> DataFrame:
    """product_id, position, image_url: one row per valid image url, made absolute."""
    return products.select(
        F.col("id").alias("product_id"), "source_url",
        F.posexplode(U.valid_image_urls(F.col("image_urls"))).alias("position", "raw")).select(
        "product_id", "position", U.absolute_image_url(F.col("raw"), F.col("source_url")).alias("image_url"))


def image_results(links: DataFrame, facts: DataFrame) -> DataFrame:
    """Per product image its result; a url without a blob is a failed download."""
    # In as many tasks as there are links for: by their bytes, which are few beside what a row takes in memory, few would do.
    tasks = tasks_for(links)
    found = facts.withColumnRenamed("url", "image_url").repartition(tasks, "image_url")
    return (links.repartition(tasks, "image_url").join(found, "image_url", "left")
            .withColumn("error", F.when(F.col("success").isNull(), "Failed to download image").otherwise(F.col("error")))
            .withColumn("success", F.coalesce("success", F.lit(False))))


def rejoin(results: DataFrame) -> DataFrame:
    """Per product the public urls of its good images in their order, and whether all were good; bounded by its own list."""
    kept = F.collect_list(F.when(F.col("success"), F.struct("position", "public_url")))
    return (results.groupBy("product_id").agg(F.sort_array(kept).alias("_urls"), F.bool_and("success").alias("complete"))
            .select("product_id", F.transform("_urls", lambda u: u["public_url"]).alias("image_urls"), "complete"))


def image_stats(results: DataFrame) -> DataFrame:
    """One row: total, ok, failed, bytes and rounded mean of the good ones, good ones per format."""
    ok = F.col("success")
    return results.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("size", F.lit(0)))), F.lit(0)).alias("total_size"),
        F.coalesce(F.round(F.avg(F.when(ok, F.coalesce("size", F.lit(0))))), F.lit(0)).cast("bigint").alias("average_size"),
        *[F.count_if(ok & (F.col("format") == f)).alias(f"format_{f}") for f in FORMATS])


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    return results.filter("success"), results.filter("not success")

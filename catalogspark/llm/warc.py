"""WARC archives of pages, with an index first: every record is found by file, offset and length."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written

MIN_SHARED = 1000            # payloads below this many bytes are always stored
ARCHIVE_BYTES = 64 << 20     # a task begins a new file beyond this size
GAP = 64 << 10               # two records this close are fetched by one read
SPAN = 8 << 20               # but a read stays near this size
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, path string, offset long, length long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "payload string")


def record_types(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """pages as page_id, url, html, digest, refers_to: which records revisit another one.

    Of the pages whose payloads are equal and have at least `min_shared` bytes, that with the largest page_id is stored;
    the others refer to it.  Only ids and digests are compared; pages that revisit are then marked by id, a join in which
    no key is common.  Rows that repeat the largest page_id are all stored; rows without an id never are referred to and
    refer to the stored one, if there is one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keys = keyed.where(F.octet_length("html") >= min_shared).select("page_id", "digest")
    stored = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # A page id is marked once for a digest, however often its row occurs.
    marks = (keys.groupBy("page_id", "digest").count().join(stored.drop("n"), "digest")
             .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
             .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"))
    return (keyed.join(marks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
            .select("page_id", "url", "html", "digest", "refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    def uri(n):
        return f"<urn:page:{'' if n is None else n}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {uri(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        from urllib.parse import quote

        head.append("WARC-Target-URI: " + quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%")))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {uri(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, index_path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of `record_types` as gzipped records under `folder` and their index as a Parquet table.

    `folder` is a URI on storage that all executors share and that pyarrow can open.  Each attempt of a task writes
    files of its own name and the index is committed by Spark, so it names only files of attempts that ended well.
    Returns the index: page_id, url, digest, path, offset, length.
    """
    def write(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        number, stream, path, offset = 0, None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                    if stream is None or offset >= archive_bytes:
                        if stream is not None:
                            stream.close()
                        path = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId():06d}-{number:04d}.warc.gz"
                        number, offset, stream = number + 1, 0, store.open_output_stream(path, compression=None)
                    data = gzip.compress(_record(page_id, url, html.encode(), digest, refers_to), 4, mtime=0)
                    stream.write(data)
                    rows.append((page_id, url, digest, path, offset, len(data)))
                    offset += len(data)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["page_id", "url", "digest", "path", "offset", "length"])
        finally:
            if stream is not None:
                stream.close()

    records.mapInArrow(write, INDEX).write.mode("overwrite").parquet(index_path)
    return records.sparkSession.read.schema(INDEX).parquet(index_path)


def byte_ranges(index: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Coalesces the selected records: one row per read, with path, start, end and its records (offset, length).

    Records of a file are sorted by offset; a new read begins after a gap, or at the next multiple of `span` bytes.  A
    file has at most an archive's records.
    """
    by_place = Window.partitionBy("path").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(by_place)
    apart = (F.col("offset") - before > gap) | (F.floor(F.col("offset") / span) > F.floor(F.lag("offset").over(by_place) / span))
    return (index.withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
            .withColumn("_read", F.sum("_new").over(by_place))
            .groupBy("path", "_read").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"),
                                          F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
            .drop("_read"))


def _parse(data: bytes):
    head, _, block = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or len(block) != int(fields["Content-Length"]) + 4 or block[-4:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    return fields, length, payload


def read_records(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that `index` names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A stored payload is checked against the length and the SHA-1 in its headers.  A revisit carries both for the full
    payload and has a null payload (see `with_payloads`); so has every record if `payloads` is false.
    """
    def read(batches: Iterator) -> Iterator:
        import gzip
        import hashlib
        from urllib.parse import unquote

        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)

        def number(uri):
            text = uri.removeprefix("<urn:page:").removesuffix(">")
            return int(text) if text else None

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.string())])
        for batch in batches:
            for path, start, end, records in zip(*(batch.column(c) for c in ("path", "start", "end", "records"))):
                start, out = start.as_py(), []
                with store.open_input_file(path.as_py()) as file:
                    data = file.read_at(end.as_py() - start, start)
                for place in records.as_py():
                    low = place["offset"] - start
                    fields, length, payload = _parse(gzip.decompress(data[low:low + place["length"]]))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    refers_to = fields.get("WARC-Refers-To")
                    url = fields.get("WARC-Target-URI")
                    out.append((number(fields["WARC-Record-ID"]), None if url is None else unquote(url), length, digest, kind,
                                None if refers_to is None else number(refers_to),
                                payload.decode() if payloads and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return byte_ranges(index, gap, span).mapInArrow(read, RECORDS)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payloads of revisits filled in from the responses they refer to."""
    records = written(records, "records")
    wanted = records.where("record_type = 'revisit'")
    stored = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(
        F.first("payload").alias("_payload"))
    found = wanted.alias("r").join(stored.alias("s"), (F.col("r.refers_to") == F.col("s.page_id"))
                                   & (F.col("r.payload_digest") == F.col("s.payload_digest"))).select(
        *[F.col(f"r.{c}") for c in records.columns if c != "payload"], F.col("_payload").alias("payload"))
    return records.where("record_type = 'response'").unionByName(found)

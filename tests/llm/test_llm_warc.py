import gzip
import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from catalogspark.llm import warc as W
from catalogspark.session import scratch_path

BIG, SAME = "<p>" + "é" * 3000 + "\r\n\r\n</p>", "<p>" + "same " * 400
PAGES = [(1, "http://a.example/x y?q=ü\n#f", SAME), (7, "http://b.example/", SAME), (3, None, SAME), (3, "http://c.example/", SAME),
         (7, "http://d.example/", SAME), (4, "http://e.example/", "short"), (5, "http://f.example/", "short"), (6, "u", None), (8, "", ""),
         (9, "http://g.example/", BIG), (None, "http://h.example/", SAME), (None, "http://i.example/", "x")]


def pages(spark):
    rows = [(*p, "z", 5) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, length int")


def archive(spark, frame, **options):
    folder = scratch_path(spark, "warc")
    return folder, W.write_archives(W.record_types(frame), folder, scratch_path(spark, "index"), **options)


def test_round_trip(spark):
    folder, index = archive(spark, pages(spark).coalesce(2), archive_bytes=600)
    assert index.count() == len(PAGES) and index.select("path").distinct().count() > 2
    got = W.with_payloads(W.read_records(index, folder)).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(((r.page_id, r.url, r.payload) for r in got), key=key) == sorted(((i, u, h or "") for i, u, h in PAGES), key=key)
    for r in got:
        data = r.payload.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisits = r.payload == SAME and r.page_id != 7
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisits else ("response", None))


def test_selected_records_are_read_by_ranges(spark):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://s.example/"), F.col("id")).alias("url"),
                                   F.concat(F.lit("<p>"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20)).alias("html"))
    folder, index = archive(spark, rows.coalesce(1))
    reads = W.byte_ranges(index, gap=0, span=1 << 30)
    assert reads.count() == index.select("path").distinct().count()
    # A selection with gaps: neighbours share a read, what lies between is skipped.
    some = index.where("page_id % 100 < 5")
    spans = W.byte_ranges(some, gap=0).collect()
    assert sum(len(s.records) for s in spans) == 20 and sum(s.end - s.start for s in spans) == some.agg(F.sum("length")).first()[0]
    assert {r.page_id for r in W.read_records(some, folder).collect()} == {i for i in range(400) if i % 100 < 5}
    assert max(s.end - s.start for s in W.byte_ranges(index, span=5000).collect()) < 5000 + 2 * 1500


def test_each_record_is_a_gzip_member_and_damage_is_seen(spark):
    folder, index = archive(spark, pages(spark).where("page_id = 9"))
    row = index.first()
    with open(row.path, "rb+") as file:
        data = file.read()
        text = gzip.decompress(data[row.offset:row.offset + row.length])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and os.path.getsize(row.path) == row.length
        file.seek(0)
        file.write(gzip.compress(text.replace("é".encode(), "è".encode(), 1), 4, mtime=0).ljust(row.length, b"\0")[:row.length])
    with pytest.raises(PySparkException):
        W.read_records(index, folder).collect()


def test_no_pages(spark):
    folder, index = archive(spark, pages(spark).limit(0))
    assert index.count() == 0 and W.read_records(index, folder).count() == 0

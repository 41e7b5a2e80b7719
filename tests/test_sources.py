"""Readers, writers, seed rows and published snapshots."""

import pytest
from pyspark.sql import functions as F

from catalogspark import schemas as S
from catalogspark.operators import tree as T
from catalogspark.plans import ingest as I
from catalogspark.session import scratch_path
from catalogspark.sources import exports as X, tables as R


def test_synthetic_products(spark):
    made = R.synthetic_products(spark.range(100), "https://e.com")
    again = R.synthetic_products(spark.range(100).repartition(7), "https://e.com")
    assert made.count() == again.count() == 100
    keep = ["source_id", "title", "price", "available", "category_id"]
    assert made.select(keep).exceptAll(again.select(keep)).count() == 0


def test_csv_escapes_quotes(spark):
    path = scratch_path(spark, "csv")
    X.export_csv(spark.createDataFrame([('say "hi", you', [1, 2])], "t string, a array<int>"), path)
    row = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert (row.t, row.a) == ('say "hi", you', "[1,2]")


def test_log_export_limit_and_format(spark):
    logs = spark.range(50).select(F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), F.lit("info").alias("level"),
                                  F.lit("queue").alias("component"), F.col("id").cast("string").alias("message"), F.lit("{}").alias("metadata"))
    got = X.log_export(logs, start=F.timestamp_seconds(F.lit(600)), limit=5)
    assert [r.message for r in got.collect()] == ["10", "11", "12", "13", "14"]
    with pytest.raises(ValueError):
        X.export_logs(logs, "/nowhere", "xml", "2024-01-01")


def test_whole_text_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>one\ntwo</h1>")
    got = R.read_pages(spark, str(tmp_path / "*.html")).collect()
    assert len(got) == 1 and got[0].html == "<h1>one\ntwo</h1>" and got[0].url.endswith("a.html")


def test_bad_json_gives_null(spark):
    rows = spark.createDataFrame([('{"k": 5}',), ('{"k": "x"}',), ("{",), (None,)], "j string")
    assert [r[0] for r in rows.select(R.json_field(F.col("j"), "$.k", "int")).collect()] == [5, None, None, None]


def test_failed_stage_publishes_nothing(spark):
    root = scratch_path(spark, "store")
    stores = {n: X.Snapshots(spark, f"{root}/{n}") for n in ("a", "b")}
    commits = X.Snapshots(spark, f"{root}/commits")
    for store in stores.values():
        store.publish(spark.range(3), 1)
    assert I.publish_all(stores, commits, [lambda s: {"a": s["a"].union(spark.range(2))}], 2) == {"a": 5}

    def broken(state):
        raise RuntimeError("stop")
    with pytest.raises(RuntimeError):
        I.publish_all(stores, commits, [lambda s: {"a": s["a"].limit(0)}, broken], 3)
    published = I.read_published(stores, commits)
    assert {n: df.count() for n, df in published.items()} == {"a": 5, "b": 3}
    # The next run starts from the committed state, not from what the failed one left behind.
    assert I.publish_all(stores, commits, [lambda s: {"b": s["a"]}], 4) == {"b": 5}


def test_defaults(spark):
    row = S.with_defaults(spark.createDataFrame([("a", None)], "id string, currency string").withColumns(
        {"specs": F.lit(None).cast("map<string,string>"), "available": F.lit(None).cast("boolean")}), "product").first()
    assert (row.currency, row.specs, row.available) == ("GBP", {}, True)

"""Operators against brute force, with hot keys, and against literal cases."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from catalogspark import schemas as S
from catalogspark.operators import catalog as C, freshness as Fr, images as Im, jobs as J, merge as M, ratelimit as R
from catalogspark.operators import metrics as X, timeline as L, tree as T, validate as V

NOW = None


@pytest.fixture(autouse=True, scope="module")
def _now(spark):
    global NOW  # a Column needs the session
    NOW = F.lit("2024-01-31 12:00:00").cast("timestamp")


def hot_requests(seed, n=3000, span_ms=6 * 3_600_000):
    """Requests where one key has half of all rows, many of them at the same instant."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(12)}"
        ts = rnd.randrange(span_ms)
        if rnd.random() < 0.4:
            ts -= ts % 20_000
        rows.append((key, ts, i))
    return rows


def brute_sliding(rows, per_minute, per_hour):
    accepted, verdict = defaultdict(deque), {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        past = accepted[key]
        hour = [t for t in past if ts - t < 3_600_000]
        ok = len([t for t in hour if ts - t < 60_000]) < per_minute and len(hour) < per_hour
        verdict[i] = ok
        if ok:
            past.append(ts)
    return verdict


@pytest.mark.parametrize("seed,per_minute,per_hour,span", [
    (1, 10, 100, 6), (2, 2, 30, 6), (3, 1, 5, 48), (4, 3, 1000, 2), (5, 1000, 50, 30)])
def test_sliding_log(spark, seed, per_minute, per_hour, span):
    rows = hot_requests(seed, span_ms=span * 3_600_000)
    frame = spark.createDataFrame(rows, "key string, ts_ms bigint, request_id bigint")
    got = {r.request_id: r.allowed for r in R.sliding_log(frame, per_minute, per_hour).collect()}
    assert got == brute_sliding(rows, per_minute, per_hour)


@pytest.mark.parametrize("step,jitter,per_minute,per_hour", [(400_000, 300_000, 1, 7), (9_000, 1, 3, 20)])
def test_a_saturated_key_is_walked_by_several_tasks(spark, step, jitter, per_minute, per_hour):
    """A key over its limit for a day: in the first case logs soon forget where they began, in the second never."""
    rnd = random.Random(step)
    rows = [("hot", k * step + rnd.randrange(jitter), k) for k in range(86_400_000 // step)]
    frame = spark.createDataFrame(rows, "key string, ts_ms bigint, request_id bigint")
    walk = frame.select("key", F.lit(1).cast("bigint").alias("run"), "ts_ms", F.lit(1).alias("n"))
    placed, pieces = R.in_pieces(walk, len(rows) // 5)
    assert pieces.count() == 6 and R.by_piece(placed).select(F.spark_partition_id()).distinct().count() >= 3
    got = {r.request_id: r.allowed for r in R.sliding_log(frame, per_minute, per_hour, len(rows) // 5).collect()}
    assert got == brute_sliding(rows, per_minute, per_hour)


def test_sliding_log_first_ten(spark):
    frame = spark.range(15).select(F.lit("k").alias("key"), F.col("id").alias("ts_ms"), F.col("id").alias("request_id"))
    got = {r.request_id: r.allowed for r in R.sliding_log(frame).collect()}
    assert [got[i] for i in range(15)] == [True] * 10 + [False] * 5


def test_fixed_minute(spark):
    rows = hot_requests(7, span_ms=600_000)
    seen, want = defaultdict(int), {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[key, ts // 60_000] += 1
        want[i] = seen[key, ts // 60_000] <= 20
    frame = spark.createDataFrame(rows, "key string, ts_ms bigint, request_id bigint")
    assert {r.request_id: r.allowed for r in R.fixed_minute(frame, 20).collect()} == want


def test_usage(spark):
    rows = hot_requests(8, n=800)
    got = {(r.key, r.ts_ms): (r.minute, r.hour) for r in R.usage(
        spark.createDataFrame(rows, "key string, ts_ms bigint, request_id bigint")).collect()}
    for key, ts, _ in rows:
        same = [t for k, t, _ in rows if k == key and t <= ts]
        assert got[key, ts] == (sum(ts - t < 60_000 for t in same), sum(ts - t < 3_600_000 for t in same))


def test_gap_sessions_running_totals_and_next(spark):
    rows = hot_requests(9, n=1500, span_ms=40 * 3_600_000)
    frame = spark.createDataFrame(rows, "key string, ts_ms bigint, request_id bigint")
    gap, want = 900_000, set()
    by_key = defaultdict(list)
    for key, ts, i in rows:
        by_key[key].append((ts, i))
    for key, items in by_key.items():
        items.sort()
        start = last = items[0][0]
        n = 0
        for ts, _ in items:
            if ts - last >= gap:
                want.add((key, start, last, n))
                start, n = ts, 0
            last, n = ts, n + 1
        want.add((key, start, last, n))
    got = {(r.key, r.start_ms, r.end_ms, r.events) for r in L.gap_sessions(frame, "key", "ts_ms", gap).collect()}
    assert got == want
    bucket = F.floor(F.col("ts_ms") / 3_600_000)
    totals = {r.request_id: (r.running_sum, r.running_count)
              for r in L.running_totals(frame, "key", ["ts_ms", "request_id"], bucket, "request_id").collect()}
    for items in by_key.values():
        total = 0
        for n, (_, i) in enumerate(items, 1):
            total += i
            assert totals[i] == (total, n)
    distinct = frame.select("key", "ts_ms").distinct()
    nexts = {(r.key, r.ts_ms): r.following for r in L.with_next(distinct, "key", "ts_ms", bucket, "following").collect()}
    for key, items in by_key.items():
        times = sorted({ts for ts, _ in items})
        assert [nexts[key, t] for t in times] == times[1:] + [None]


# ---- tree -----------------------------------------------------------------------------------------------

def nav(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, parent_id string")


TREE = [("1", "Books", None), ("2", "Fiction", "1"), ("3", "Science", "1"), ("4", "Crime", "2"), ("5", "Science Fiction", "2"),
        ("6", "Physics", "3"), ("7", "Lost", "99"), ("8", "Loop A", "9"), ("9", "Loop B", "8"), ("10", "Space", "5")]


def test_hierarchy(spark):
    tree = {r.id: r for r in T.hierarchy(nav(spark, TREE)).collect()}
    assert set(tree) == {"1", "2", "3", "4", "5", "6", "10"}
    assert tree["10"].path == ["1", "2", "5", "10"] and tree["10"].depth == 3
    ordered = [r.title for r in T.in_display_order(T.hierarchy(nav(spark, TREE))).collect()]
    assert ordered == ["Books", "Fiction", "Crime", "Science Fiction", "Space", "Science", "Physics"]
    mixed = T.hierarchy(nav(spark, [("1", "apple", None), ("2", "Banana", None), ("3", "\u00c4pfel", None)]))
    assert [r.title for r in T.in_display_order(mixed).collect()] == ["Banana", "apple", "\u00c4pfel"]
    assert [r.title for r in T.in_display_order(mixed, "UNICODE").collect()] == ["\u00c4pfel", "apple", "Banana"]


def test_search_tree(spark):
    tree = T.hierarchy(nav(spark, TREE))
    found = lambda q: {r.id for r in T.search_tree(tree, q).collect()}
    # A match without deeper matches keeps its subtree; one with deeper matches is narrowed to them.
    assert found("scien") == {"1", "2", "5", "10", "3", "6"}
    assert found("fiction") == {"1", "2", "5", "10"}
    assert found("crime") == {"1", "2", "4"}
    assert found("books") == {"1", "2", "3", "4", "5", "6", "10"}
    assert found("nothing") == set()


def test_cascade_in_a_cycle(spark):
    navigation = nav(spark, TREE)
    categories = spark.createDataFrame([("c1", "8"), ("c2", "3"), ("c3", None)], "id string, navigation_id string")
    products = spark.createDataFrame([("p1", "c1"), ("p2", "c2"), ("p3", None)], "id string, category_id string")
    doomed = navigation.filter(F.col("id") == "9")
    n, c, p = T.cascade_delete(navigation, categories, products, doomed)
    assert {r.id for r in n.collect()} == {"1", "2", "3", "4", "5", "6", "7", "10"}
    assert {r.id for r in c.collect()} == {"c2", "c3"}
    assert {(r.id, r.category_id) for r in p.collect()} == {("p1", None), ("p2", "c2"), ("p3", None)}


# ---- merge ----------------------------------------------------------------------------------------------------

def products(spark, rows):
    frame = spark.createDataFrame(rows, "id string, source_url string, title string, price double, currency string")
    filled = {f.name: F.col(f.name) if f.name in frame.columns else F.lit(None) for f in S.PRODUCT}
    return frame.select(*[filled[f.name].cast(f.dataType).alias(f.name) for f in S.PRODUCT])


def test_latest_row_of_a_hot_key(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}", rnd.choice([None, -5, 3, 2**40]), rnd.randrange(4), rnd.random() < 0.5, f"p{i % 50}")
            for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, a bigint, b int, c boolean, payload string").withColumn("m", F.create_map("payload", "k"))
    first = lambda v: (v is not None, v or 0)
    for order in (["a"], ["a", "b"], ["b", "c"], ["payload", "a"]):
        got = M.latest_per_key(frame, "k", order)
        found = {r.k: r for r in got.collect()}
        at = [frame.columns.index(c) for c in order]
        value = lambda r: [first(r[i]) if not isinstance(r[i], str) else r[i] for i in at]
        for k in {r[0] for r in rows}:
            assert value(tuple(found[k])) == max(value(r) for r in rows if r[0] == k)
        assert found.keys() == {r[0] for r in rows} and got.count() == len(found)
        again = {r.k: r for r in M.latest_per_key(frame.repartition(7), "k", order).collect()}
        assert again == found                                        # ties go by content
    plan = M.latest_per_key(frame, "k", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_upsert_modes(spark):
    stored = products(spark, [("a", "u1", "Old", 5.0, "EUR"), ("b", "u2", "Keep", None, "USD")])
    scraped = spark.createDataFrame([("u1", "New", None, 2), ("u1", "Older", 9.0, 1), ("u3", "Add", 3.0, 1)],
                                    "source_url string, title string, price double, at int")
    def run(mode):
        rows = M.upsert(stored, scraped, "product", NOW, ["at"], mode).collect()
        return {r.source_url: r for r in rows}
    got = run("overwrite")
    assert (got["u1"].title, float(got["u1"].price), got["u1"].action, got["u1"].id) == ("New", 5.0, "update", "a")
    assert got["u2"].action == "keep" and got["u2"].updated_at is None
    assert (got["u3"].action, got["u3"].currency, got["u3"].available, got["u3"].specs) == ("insert", "GBP", True, {})
    assert got["u3"].id == run("overwrite")["u3"].id and len(got["u3"].id) == 64
    assert run("overwrite_all")["u1"].price is None
    filled = run("fill_only")
    assert (filled["u1"].title, filled["u1"].currency) == ("Old", "EUR")


def test_count_changes_match_recount(spark):
    cats = spark.createDataFrame([("c1", 2), ("c2", 1), ("c3", 0)], "id string, product_count int")
    feed = spark.createDataFrame([("insert", None, "c1"), ("delete", "c2", None), ("move", "c1", "c3"), ("insert", None, None)],
                                 "op string, old_category_id string, new_category_id string")
    assert {r.id: r.product_count for r in M.apply_count_changes(cats, feed).collect()} == {"c1": 2, "c2": 0, "c3": 1}


# ---- jobs --------------------------------------------------------------------------------------------------------

def job_rows(spark, rows):
    frame = spark.createDataFrame(rows, "id string, status string, attempts int, priority int, locked_by string, locked_ago int, age int, last_error string")
    filled = {f.name: F.col(f.name) if f.name in frame.columns else F.lit(None) for f in S.SCRAPE_JOB}
    filled |= {"type": F.lit("product"), "target_url": F.concat(F.lit("https://e.com/"), "id"),
               "locked_at": NOW - F.make_dt_interval(mins=F.col("locked_ago")), "created_at": NOW - F.make_dt_interval(mins=F.col("age")),
               "updated_at": NOW - F.make_dt_interval(mins=F.col("age")), "max_attempts": F.lit(3)}
    return S.with_defaults(frame.select(*[filled[f.name].cast(f.dataType).alias(f.name) for f in S.SCRAPE_JOB]), "scrape_job")


JOBS = [("q1", "queued", 0, 1, None, None, 50, None), ("q2", "queued", 0, 9, None, None, 10, None), ("q3", "queued", 0, 9, None, None, 20, None),
        ("r1", "running", 1, 5, "w1", 5, 30, None), ("r2", "running", 3, 9, "w2", 30, 60, None), ("f1", "failed", 1, 5, None, None, 3, "x"),
        ("f2", "failed", 2, 5, None, None, 90, "y"), ("f3", "failed", 3, 5, None, None, 90, None), ("f4", "failed", 0, 5, None, None, 1, None)]


def test_dispatch_plan(spark):
    plan = J.dispatch_plan(job_rows(spark, JOBS), ["a", "b"], 3, NOW).orderBy("position").collect()
    assert [(r.id, r.locked_by, r.attempts) for r in plan] == [("r2", "a", 4), ("q3", "b", 1), ("q2", "a", 1)]


def test_retry_and_requeue(spark):
    jobs = job_rows(spark, JOBS)
    assert [r.id for r in J.retryable(jobs, NOW).collect()] == ["f2", "f4"]
    requeued = {r.id for r in J.requeue(jobs, NOW, 2).filter("released").collect()}
    assert requeued == {"f2", "f1"}


def test_outcomes_need_the_lock(spark):
    jobs = job_rows(spark, JOBS)
    outcome = spark.createDataFrame([("r1", "w1", "boom"), ("r2", "w1", "boom")], "id string, worker string, error string").withColumn(
        "metadata", F.create_map(F.lit("k"), F.lit("v")))
    failed = {r.id: r for r in J.fail(jobs, outcome, NOW).collect()}
    assert (failed["r1"].status, failed["r1"].locked_by, failed["r1"].last_error, failed["r1"].completed_at) == ("queued", None, "boom", None)
    assert (failed["r2"].status, failed["r2"].locked_by, failed["r2"].changed) == ("running", "w2", False)
    own = outcome.withColumn("worker", F.when(F.col("id") == "r2", "w2").otherwise("w1"))
    assert {r.id: r.status for r in J.fail(jobs, own, NOW).filter("changed").collect()} == {"r1": "queued", "r2": "failed"}
    done = J.complete(jobs, own.withColumns({"duration": F.lit(5), "items": F.lit(2)}).drop("error"), NOW)
    row = {r.id: r for r in done.collect()}["r1"]
    assert row.status == "completed" and row.completed_at is not None
    assert row.metadata == {"k": "v", "duration": "5", "itemsProcessed": "2", "completedBy": "w1"}


def test_enqueue(spark):
    jobs = job_rows(spark, JOBS)
    asked = spark.createDataFrame([("https://e.com/q1", 4, 1), ("https://e.com/q1", 2, 2), ("https://e.com/q2", 1, 3), ("https://e.com/f1", 6, 4)],
                                  "target_url string, priority int, seq int").withColumns(
        {"type": F.lit("product"), "metadata": F.create_map(F.lit("n"), F.col("seq").cast("string"))})
    changes = {r.target_url[14:]: (r.action, r.priority, r.metadata["n"]) for r in J.enqueue(jobs, asked).collect()}
    assert changes == {"q1": ("raise", 4, "1"), "q2": ("raise", 9, "3"), "f1": ("insert", 6, "4")}
    after = J.apply_enqueue(jobs, J.enqueue(jobs, asked), NOW)
    assert after.count() == len(JOBS) + 1 and after.columns == jobs.columns


def test_health_of_no_jobs(spark):
    row = J.queue_health(job_rows(spark, JOBS).limit(0), NOW).first()
    assert (row.total_jobs, row.oldest_queued_age_s, row.oldest_running_age_s) == (0, 0, 0)
    assert J.recent_outcomes(job_rows(spark, JOBS).limit(0), NOW).first().success_rate == 100.0


# ---- the rest -----------------------------------------------------------------------------------------------------

def test_page_arguments():
    for bad in (dict(limit=0), dict(limit=101), dict(offset=-1), dict(sort="size"), dict(category_id="x")):
        with pytest.raises(ValueError, match="Validation error"):
            C.check_page(**bad)
    C.check_page(category_id="550e8400-e29b-41d4-a716-446655440000")


def test_price_sort_puts_nulls_last_both_ways(spark):
    rows = products(spark, [("a", "u1", "A", 5.0, "GBP"), ("b", "u2", "B", None, "GBP"), ("c", "u3", "C", 7.0, "GBP")])
    ids = lambda sort: [r.id for r in C.product_page(rows, sort).collect()]
    assert ids("price_asc") == ["a", "c", "b"] and ids("price_desc") == ["c", "a", "b"]


def test_page_meta(spark):
    row = C.page_meta(spark.range(45), 20, 20).first()
    assert tuple(row) == (45, 2, 20, 3, True, True)
    assert tuple(C.page_meta(spark.range(0), 20, 0).first()) == (0, 1, 20, 0, False, False)


def test_fail_fast(spark):
    rows = spark.createDataFrame([("A", "https://e.com/1", None), ("", "https://e.com/2", None)], "title string, source_url string, parent_id string")
    good, bad = V.split_valid(rows, V.rules("write_navigation"))
    assert [r.title for r in good.collect()] == ["A"] and bad.first().errors == ["title: required"]
    with pytest.raises(Exception, match="title: required"):
        V.require_valid(rows, V.rules("write_navigation")).collect()


def test_cache_health_levels(spark):
    def verdict(hits, misses, stale, errors):
        kinds = ["hit"] * hits + ["miss"] * misses + ["stale"] * stale + ["error"] * errors
        row = Fr.cache_health(Fr.cache_stats(spark.createDataFrame([(k,) for k in kinds], "outcome string"))).first()
        return row.status, len(row.issues)
    assert verdict(90, 5, 5, 0) == ("healthy", 0)
    assert verdict(90, 5, 5, 7) == ("degraded", 1)
    assert verdict(2, 20, 60, 20) == ("unhealthy", 3)
    assert verdict(0, 1, 0, 0) == ("healthy", 0)


def test_image_statistics(spark):
    # A golden case of the image statistics.
    rows = [(True, 1000, "jpeg"), (True, 2000, "png"), (True, 3000, "jpeg"), (False, None, None)]
    row = Im.image_stats(spark.createDataFrame(rows, "success boolean, size bigint, format string")).first()
    assert (row.total_processed, row.successful, row.failed, row.total_size, row.average_size, row.format_jpeg, row.format_png) == (4, 3, 1, 6000, 2000, 2, 1)
    empty = Im.image_stats(spark.createDataFrame(rows, "success boolean, size bigint, format string").limit(0)).first()
    assert (empty.total_size, empty.average_size) == (0, 0)


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc2\x00\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\x03"
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((7 - 1) | (9 - 1) << 14).to_bytes(4, "little") + b"\0" * 8
    assert Im._size_of(png) == ("png", 640, 480)
    assert Im._size_of(jpeg) == ("jpeg", 40, 30)
    assert Im._size_of(lossless) == ("webp", 7, 9)
    assert Im._size_of(b"GIF89a" + b"\x05\x00\x06\x00") == ("gif", 5, 6)
    assert Im._size_of(b"<html>") == (None, None, None)


def test_image_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.jpg").write_bytes(b"")
    (tmp_path / "c.gif").write_bytes(b"nonsense")
    got = {r.url[-5:]: r for r in Im.inspect(Im.read_blobs(spark, str(tmp_path)), "https://i.example.com/").collect()}
    assert (got["a.png"].success, got["a.png"].format, got["a.png"].dimensions.width) == (True, "png", 3)
    assert got["a.png"].public_url.startswith("https://i.example.com/products/") and got["a.png"].object_key.endswith(".png")
    assert got["c.gif"].error == "Unsupported format"
    assert "b.jpg" not in got  # the file source skips empty files; such an image counts as not downloaded


def test_display_positions_number_the_nodes_without_one_window_over_all(spark):
    nodes = spark.createDataFrame([(f"n{i:04d}", f"title {(i * 7919) % 1009}", f"n{(i - 1) // 9:04d}" if i else None) for i in range(1000)],
                                  "id string, title string, parent_id string").repartition(7)
    tree = T.hierarchy(nodes)
    wanted = [r.id for r in sorted(tree.collect(), key=lambda r: (r.title_path, r.path))]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are borders to cross
    try:
        placed = T.display_positions(tree)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [(r.position, r.id) for r in placed.orderBy("position").collect()] == list(enumerate(wanted, 1))
    assert "row_number" not in placed._jdf.queryExecution().toString()


# ---- deep pages and percentiles ---------------------------------------------------------------------------------

def test_a_deep_page_sorts_only_the_ranges_that_hold_it(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, *range(40)]), f"p{i}") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "id int, price int, payload string").repartition(6)
    order = [F.col("price").desc_nulls_last(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for offset in (0, 7_490, 19_990, 30_000):
        got = C.deep_page(frame, order, ["id"], ["price"], 20, offset).collect()
        assert [tuple(r) for r in got] == want[offset:offset + 20]


def test_percentiles_of_merged_sketches(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(3)}", 1_700_000_000 + rnd.randrange(5 * 86_400), rnd.expovariate(0.01)) for _ in range(30_000)]
    rows += [("few", 1_700_000_000, float(k)) for k in range(11)] + [("few", 1_700_000_000, None), ("none", 1_700_000_000, None)]
    frame = spark.createDataFrame(rows, "endpoint string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    hourly = X.percentile_sketches(frame, ["endpoint"])
    merged = X.merge_sketches(X.merge_sketches(hourly, ["endpoint"], "1 day"), ["endpoint"])
    got = {r.endpoint: r for r in X.percentiles(merged, {"p50": 0.5, "p95": 0.95}).collect()}
    for name in ("hot", "k0", "k1", "k2"):
        values = sorted(v for k, _, v in rows if k == name)
        assert got[name].n == len(values) and got[name].max_value == values[-1]
        for share, found in ((0.5, got[name].p50), (0.95, got[name].p95)):
            assert abs(sum(v <= found for v in values) / len(values) - share) < 0.03
    assert got["few"].p50 == 5.0 and got["few"].n == 11 and "none" not in got


def test_refresh_of_expired_keys_where_asked_for(spark):
    key = "https://cache.example.com/product_detail:id="
    entries = spark.createDataFrame([(f"{key}{f}", f) for f in ("fresh", "stale", "expired")], "key string, freshness string")
    kinds = lambda **how: sorted((r.target_url[-7:], r.metadata["revalidation_type"]) for r in Fr.refresh_requests(entries, "https://s", **how).collect())
    assert kinds() == [("t/stale", "stale")]
    assert kinds(expired=True) == [("expired", "expired"), ("t/stale", "stale")]


def test_small_files_are_listed_by_the_tasks_that_read_them(spark, tmp_path):
    files = [(f"{i}.png", bytes(i)) for i in range(40)]
    Im.write_blobs(spark.createDataFrame(files, "name string, content binary"), str(tmp_path), shards=8).collect()
    found = {r.url.rsplit("/", 1)[1]: (r.length, r.content) for r in Im.scan_blobs(spark, str(tmp_path), 30, shards=8).collect()}
    assert found == {f"{i}.png": (i, bytes(i) if i <= 30 else None) for i in range(1, 40)}
    assert len(list(tmp_path.iterdir())) <= 8 and Im.scan_blobs(spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_image_results_are_joined_in_as_many_tasks_as_cores(spark):
    links = spark.createDataFrame([("p", 0, "u")], "product_id string, position int, image_url string")
    facts = spark.createDataFrame([("u", True, None)], "url string, success boolean, error string")
    got = Im.image_results(links, facts)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and [r.success for r in got.collect()] == [True]


def test_sliding_counts_are_running_totals(spark):
    rnd = random.Random(5)
    times = sorted(rnd.randrange(-500, 3000) for _ in range(400))
    got = L.sliding_counts(spark.createDataFrame([("k", t) for t in times], "key string, ts_ms bigint"), "key", "ts_ms", {"short": 7, "long": 100})
    count = lambda t, w: sum(t - w < x <= t for x in times)
    assert sorted(map(tuple, got.collect())) == [("k", t, times.count(t), count(t, 7), count(t, 100)) for t in sorted(set(times))]
    assert "unboundedpreceding" in got._jdf.queryExecution().toString().lower()

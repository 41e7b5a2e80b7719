"""Streams fed in several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import jobs as J, merge as M, metrics as X, ratelimit as R, timeline as TL
from catalogspark.plans import queries_streams as Q
from catalogspark.session import scratch_path
from catalogspark.sources import adapters as A
from catalogspark.sources.exports import BucketedTable
from catalogspark.streaming import keyed as K, streams as T


@pytest.fixture(scope="module")
def split(spark, sf_dir):
    """Events written as five files in time order; the stream takes one per micro-batch."""
    path = scratch_path(spark, "split-events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    n = events.count()
    for i in range(5):
        part = events.filter((F.col("event_id") >= n * i // 5) & (F.col("event_id") < n * (i + 1) // 5))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = lambda: T.read_stream(spark, path, events.schema, files_per_trigger=1)
    return events, stream


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_deduplicate(split):
    events, stream = split
    twice = stream().withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    got = T.drain(T.deduplicated(twice, "event_id"), "t")
    assert rows(got, "event_id") == rows(events, "event_id")


def test_error_windows(split):
    events, stream = split
    logs = lambda df: df.select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "error").alias("level"))
    got = T.drain_updates(X.error_windows(logs(stream()).withWatermark("timestamp", "5 minutes"), threshold=1), "t",
                          ["window_start", "window_end"])
    want = X.error_windows(logs(events), threshold=1)
    assert rows(got, "window_start", "errors", "alert", "projected_rate") == rows(want, "window_start", "errors", "alert", "projected_rate")


def test_sessions_close_once(split):
    events, stream = split
    got = T.drain(T.sessions(stream().withWatermark("ts", "5 minutes"), "user_id"), "t")
    want = T.sessions(events, "user_id")
    last = events.agg(F.max("ts")).first()[0]
    closed = want.filter(F.col("last_at") + F.expr("INTERVAL 35 MINUTES") <= F.lit(last))
    assert rows(got, "user_id", "start_at", "events") == rows(closed, "user_id", "start_at", "events")


def test_rate_limit(spark, split):
    events, stream = split
    ask = lambda df: df.select(F.col("event_type").alias("key"), F.unix_millis("ts").alias("ts_ms"), F.col("event_id").alias("request_id"))
    got = T.drain(K.rate_limit(ask(stream()), 1, 2), "t", keyed=True)
    assert got.filter("late").isEmpty()
    assert rows(got, "request_id", "allowed") == rows(R.sliding_log(ask(events), 1, 2), "request_id", "allowed")


def test_fixed_minute(spark, split):
    events, stream = split
    # A day per minute, so that minutes are full and micro-batch borders fall inside them.
    ask = lambda df: df.select(F.lit("all").alias("key"), F.floor(F.unix_millis("ts") / 1440).alias("ts_ms"), F.col("event_id").alias("request_id"))
    got = T.drain(K.fixed_minute(ask(stream()), 20), "t", keyed=True)
    want = R.fixed_minute(ask(events), 20)
    assert rows(got, "request_id", "position", "allowed") == rows(want, "request_id", "position", "allowed")


MINUTES = [[(20, 1), (20, 2)], [(5, 3), (5, 4), (18, 5), (18, 6)], [(18, 7), (5, 8)], [(90, 9)], [(20, 10), (88, 11)]]


def _in_files(spark, groups):
    """A stream whose micro-batches are the groups of (minute, request_id), in this order."""
    import time

    path = scratch_path(spark, "files")
    schema = "key string, ts_ms long, request_id long"
    for group in groups:
        rows = [("k", m * 60_000 + r, r) for m, r in group]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source goes by the time of the files
    return T.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def _drained(stream):
    """Rows of a stream with state by key, and its state rows after each micro-batch."""
    out = scratch_path(stream.sparkSession, "t")
    query = T.start_keyed(stream, out)
    query.awaitTermination()
    kept = [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data").collect(), kept


def test_fixed_minute_sets_late_requests_apart(spark):
    found, kept = _drained(K.fixed_minute(_in_files(spark, MINUTES), 2))
    got = {r.request_id: (r.position, r.allowed) for r in found if not r.late}
    # Minute 18 was within the delay, and its third request is denied; minute 5, and 20 after 90, are late.
    assert got == {1: (1, True), 2: (2, True), 5: (1, True), 6: (2, True), 7: (3, False), 9: (1, True), 11: (1, True)}
    assert {r.request_id for r in found if r.late} == {3, 4, 8, 10}
    assert max(kept) == 2 and kept[-1] == 1       # the hour of minute 20 is gone


def test_sliding_limit_forgets_keys_that_do_not_return(spark):
    groups = [[(m, m)] for m in (0, 500, 1000, 996, 400)]
    keyed = _in_files(spark, groups).withColumn("key", F.concat(F.lit("k"), F.col("request_id").cast("string")))
    found, kept = _drained(K.rate_limit(keyed, 1, 2))
    assert {r.request_id for r in found if r.allowed} == {0, 500, 1000, 996}
    assert {r.request_id for r in found if r.late} == {400}
    assert max(kept) == 2 and kept[-1] == 2       # of five keys; only those of the last hour and the delay are kept


def test_sliding_limit_counts_what_lies_behind_a_request_out_of_order(spark):
    # Minutes 61 and 62 were accepted before 3 came: with it the hour from 3 to 62 would hold three.
    found, _ = _drained(K.rate_limit(_in_files(spark, [[(61, 1), (62, 2)], [(3, 3), (1, 4)], [(125, 5)]]), 5, 2, "100 minutes"))
    assert {r.request_id: r.allowed for r in found} == {1: True, 2: True, 3: False, 4: False, 5: True}


def _job(minute, seq, kind, job="j", worker="w", error=None):
    return (job, minute, seq, kind, worker, error, 2)


def test_lock_timers_requeue_and_finished_jobs_leave(spark):
    import time

    batches = [[_job(0, 0, "enqueue"), _job(1, 1, "claim"), _job(0, 0, "enqueue", "k"), _job(2, 1, "claim", "k")],
               [_job(30, 2, "complete", "k")],                                # in time, though its lock has run out by now
               [_job(60, 0, "enqueue", "m"), _job(20, 2, "claim", worker="v")],  # behind the watermark
               [_job(3000, 0, "enqueue", "n")], [_job(3001, 1, "claim", "n")]]
    path, schema = scratch_path(spark, "files"), "job_id string, minute int, seq int, kind string, worker string, error string, max_attempts int"
    for batch in batches:
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_millis(F.col("minute") * 60_000)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = T.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    found, kept = _drained(K.job_states(stream))
    told = {}
    for r in sorted(found, key=lambda r: (r.job_id, r.version or 0)):
        told.setdefault(r.job_id, []).append((r.status, r.cause, r.at_ms // 60_000))
    assert told["j"] == [(None, "claim", 20), ("running", "claim", 1), ("queued", "lock expired", 11)]
    assert told["k"][0] == ("running", "claim", 2) and told["k"][-1] == ("completed", "complete", 30)
    assert told["n"][0] == ("queued", "enqueue", 3000) and told["n"][1] == ("running", "claim", 3001)
    assert [r.job_id for r in found if r.late] == ["j"]
    assert kept[-1] < max(kept)                                   # j, k and m have left the state


def test_sessions_by_id_close_and_leave_the_state(spark, split):
    events, stream = split
    name = lambda df: df.select(F.concat(F.lit("s"), F.col("user_id")).alias("session_id"), F.unix_millis("ts").alias("ts_ms"))
    found, kept = _drained(K.sessions_by_id(name(stream()), gap="2 hours"))
    got = sorted((r.session_id, r.start_ms, r.end_ms, r.events) for r in found if not r.late)
    end = events.agg(F.max(F.unix_millis("ts"))).first()[0] - 300_000
    want = [(r.session_id, r.start_ms, r.end_ms, r.events) for r in TL.gap_sessions(name(events), "session_id", "ts_ms", 7_200_000).collect()
            if r.end_ms + 7_200_000 <= end]
    assert got == sorted(want) and kept[-1] < max(kept)


def test_split_keeps_rows_without_a_time(spark):
    rows = spark.createDataFrame([(1, 10_000, 9_000), (2, None, 9_000), (3, 900_000, 9_000)], "id int, r long, s long").select(
        "id", F.timestamp_millis("r").alias("r"), F.timestamp_millis("s").alias("s"))
    on_time, late = T.split_late(rows, "r", "s")
    assert [r.id for r in on_time.collect()] == [1] and sorted(r.id for r in late.collect()) == [2, 3]


def test_stream_without_rows(spark, split):
    events, stream = split
    got = T.drain_updates(T.sessions_by_id(stream().filter("false").select(
        F.lit("s").alias("session_id"), F.unix_millis("ts").alias("ts_ms"))), "t", ["session_id"])
    assert got.columns == ["session_id", "events", "start_ms", "end_ms"] and got.count() == 0


def test_job_fold(spark, sf_dir):
    events = Q.job_events(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    path = scratch_path(spark, "job-events")
    # The order of the files is not that of the events.
    events.repartition(4, "seq").write.parquet(path)
    stream = T.read_stream(spark, path, events.schema, files_per_trigger=1)
    got = T.drain_updates(T.fold_jobs(stream), "t", ["job_id"])
    columns = ["job_id", "status", "attempts", "last_error", "completed_at", "locked_at", "locked_by"]
    want = T.fold_jobs(events)
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))


def test_fold_equals_the_queue_operators(spark):
    """The fold of one job's events agrees with applying the queue operations one by one."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    request = spark.createDataFrame([("j", "product", "https://e.com/1", 5)], "id string, type string, target_url string, priority int")
    jobs = J.new_jobs(request, now)
    events = [("j", 0, "enqueue", None, None)]
    for attempt in range(1, 4):
        plan = J.dispatch_plan(jobs, ["w"], 1, now).select("id", "status", "attempts", "locked_by", "locked_at")
        jobs = M.apply_changes(jobs, plan)
        events.append(("j", 2 * attempt - 1, "claim", "w", None))
        bad = spark.createDataFrame([("j", "w", f"e{attempt}")], "id string, worker string, error string").withColumn(
            "metadata", F.create_map().cast("map<string,string>"))
        jobs = J.fail(jobs, bad, now).drop("changed")
        events.append(("j", 2 * attempt, "fail", "w", f"e{attempt}"))
    frame = spark.createDataFrame(events, "job_id string, seq int, kind string, worker string, error string").withColumns(
        {"ts": now, "max_attempts": F.lit(3)})
    columns = ["status", "attempts", "last_error", "locked_by"]
    assert tuple(T.fold_jobs(frame).select(*columns).first()) == tuple(jobs.select(*columns).first()) == ("failed", 3, "e3", None)


def _files(spark, folder):
    return sorted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
                  .select("path", "modificationTime", "length").collect())


def test_upsert_batches_touch_their_buckets(spark, sf_dir):
    products = A.product(spark, sf_dir)
    root = scratch_path(spark, "t-store")
    store = BucketedTable(spark, root, products.schema, buckets=32)
    store.replace(products, list(range(32)), 0)
    assert rows(store.read(), "source_url") == rows(products, "source_url")
    first = _files(spark, f"{root}/data/v=000000000000")
    urls = [r.source_url for r in products.select("source_url").limit(3).collect()]
    path = scratch_path(spark, "t-scraped")
    for i in range(4):  # two known rows and a new one in each batch
        new = [(urls[i % 3], f"title {i}", i), (urls[2], f"again {i}", i), (f"https://garden.example.com/new/{i}", f"new {i}", i), (None, "lost", i)]
        spark.createDataFrame(new, "source_url string, title string, at int").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    T.upsert_stream(T.read_stream(spark, path, schema, files_per_trigger=1), store, "product", A.as_of(), ["at"], keep=5)
    assert store.read().count() == products.count() + 4
    titles = {r.source_url: r.title for r in store.read().filter(F.col("title").rlike("^(title|again|new) [0-9]$")).collect()}
    assert len(titles) == 7 and titles[urls[2]].startswith("again")
    for version in range(1, 5):
        assert len(_files(spark, f"{root}/data/v={version:012d}")) <= 3
    assert _files(spark, f"{root}/data/v=000000000000") == first

    # A repeated batch changes nothing; then what no newer layout names goes.
    before = sorted(map(repr, store.read().collect()))
    again = spark.createDataFrame([(urls[0], "title 9", 9)], "source_url string, title string, at int")
    merge = lambda current, new: M.upsert(current, new, "product", A.as_of(), ["at"]).drop("action")
    for _ in range(2):
        touched = store.merge(again, 5, merge)
        after = sorted(map(repr, store.read().collect()))
        assert len(touched) == 1 and len(after) == len(before) and len(set(after) - set(before)) <= 1
    gone = store.expire(1)
    assert gone and sorted(map(repr, store.read().collect())) == after
    assert store.expire(1) == [] and len(_files(spark, f"{root}/data/v=000000000000")) < len(first)


def test_progress(spark, split):
    seen = []
    listener = T.Progress(lambda batch, rows_in, state: seen.append((batch, rows_in)))
    spark.streams.addListener(listener)
    try:
        events, stream = split
        T.drain(stream().select("event_id"), "t")
        import time
        for _ in range(50):
            if sum(n for _, n in seen) >= events.count():
                break
            time.sleep(0.2)
        assert sum(n for _, n in seen) == events.count() and len([n for _, n in seen if n]) == 5
    finally:
        spark.streams.removeListener(listener)


def test_a_busy_key_is_not_gathered_in_tables(spark):
    """Of each row two numbers are held, and verdicts come out one by one."""
    from collections.abc import Iterator
    from pyspark.sql import Row
    asked, late = K._in_time(iter([Row(ts_ms=t, request_id=i) for i, t in enumerate([30, 10, 20, 10, 5])]), 10, "request_id")
    assert isinstance(asked, Iterator) and list(asked) == [(10, 1), (10, 3), (20, 2), (30, 0)] and late == [(5, 4)]


def test_jobs_of_a_bucket_share_one_state_and_one_timer(spark):
    """Events in any order over several files, many jobs to a bucket: the same states as job by job, in few rows of state."""
    import random
    import time

    rng, events = random.Random(4), []
    for k in range(400):
        n, last = k % 4, 0
        events.append(_job(0, 0, "enqueue", f"j{k}"))
        for attempt in range(n):
            last += 1 + k % 3
            events.append(_job(last, 2 * attempt + 1, "claim", f"j{k}", f"w{attempt}"))
            if attempt < n - 1 or k % 5 == 0:
                events.append(_job(last, 2 * attempt + 2, "fail", f"j{k}", error=f"e{attempt}"))
        if n and k % 5 in (1, 2):
            events.append(_job(last + 1, 2 * n, "complete", f"j{k}"))
    events.append(_job(1, 1, "claim", None))
    rng.shuffle(events)
    batches = [*(events[k::3] for k in range(3)), [_job(200, 0, "enqueue", "later")], [_job(9000, 0, "enqueue", "last")]]
    path, schema = scratch_path(spark, "files"), "job_id string, minute int, seq int, kind string, worker string, error string, max_attempts int"
    for batch in batches:
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_millis(F.col("minute") * 60_000)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stored = spark.read.parquet(path)
    found, kept = _drained(K.job_states(T.read_stream(spark, path, stored.schema, files_per_trigger=1), delay="1 hour", buckets=8))
    assert not any(r.late for r in found) and len({(r.job_id, r.version) for r in found}) == len(found)
    assert max(kept) <= 8 and kept[-1] <= 2                     # rows of state are buckets; all but the last jobs have left
    want = {r.job_id: r for r in T.fold_jobs(stored).collect()}
    by = {}
    for r in sorted(found, key=lambda r: r.version):
        by.setdefault(r.job_id, []).append(r)
    assert set(by) == set(want)
    for job, states in by.items():
        w, told = want[job], [r for r in states if r.cause != "lock expired"][-1]
        assert (told.status, told.attempts, told.last_error, told.locked_by) == (w.status, w.attempts, w.last_error, w.locked_by)
        freed = [r for r in states if r.cause == "lock expired"]
        assert len(freed) == (w.status == "running") and all(
            (r.status, r.at_ms, r.locked_by) == ("queued", told.at_ms + 600_000, None) and r is states[-1] for r in freed)


def test_a_job_event_without_a_time_is_refused(spark):
    path = scratch_path(spark, "files")
    spark.createDataFrame([("j", None, 0, "enqueue", "w", None, 2)], "job_id string, ts timestamp, seq int, kind string, worker string, error string, max_attempts int").write.parquet(path)
    with pytest.raises(Exception, match="a job event without a time"):
        _drained(K.job_states(T.read_stream(spark, path, spark.read.parquet(path).schema)))

"""Streams that remember something of each key between micro-batches: state, watermark and timers are Spark's.

A processor gets the rows of one key of a micro-batch, and is called again when a timer of the key has been passed by the
watermark.  Rows behind the watermark are not dropped but handed back marked `late`.  State leaves with its timer.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ratelimit as R

PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_PART = 10_000      # rows of a key that are turned from their arrays at a time


class _Remembering(StatefulProcessor):
    """One row of state for each key, kept until its one timer fires.  Each call of Spark's costs, so there are few."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", f"{self.STATE}, until_ms bigint")

    def recall(self) -> tuple | None:
        """The state of the key, and which moment its timer is set to."""
        known = self.state.get()
        self.until_ms = known[-1] if known else None
        return tuple(known)[:-1] if known else None

    def keep(self, value: tuple, until_ms: int, fired: bool = False) -> None:
        """After `recall`: new state and a timer, in place of the one there was unless that has fired."""
        self.state.update((*value, until_ms))
        if until_ms != self.until_ms or fired:
            if self.until_ms is not None and not fired:
                self.handle.deleteTimer(self.until_ms)
            self.handle.registerTimer(until_ms)

    def forget(self) -> None:
        self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def _in_time(rows: Iterator[Row], watermark: int, tie: str) -> tuple[Iterator[tuple[int, int]], list[tuple[int, int]]]:
    """(ts_ms, `tie`) of a key's rows of a micro-batch in order, and those behind the watermark.

    Only these two numbers are held of each row: one key may have most rows of a micro-batch.
    """
    at, ties, late = array("q"), array("q"), []
    for row in rows:
        if row.ts_ms < watermark:
            late.append((row.ts_ms, row[tie]))
        else:
            at.append(row.ts_ms)
            ties.append(row[tie])
    order = np.lexsort((ties, at))
    parts = (order[k:k + _PART] for k in range(0, len(order), _PART))
    asked = (pair for part in parts for pair in zip(np.asarray(at)[part].tolist(), np.asarray(ties)[part].tolist()))
    return asked, late


def watched(stream: DataFrame, ts_ms: str, delay: str) -> DataFrame:
    """Give a stream the watermark of a column of milliseconds.  Only its progress is used: no operator drops rows by it."""
    return stream.withColumn("_at", F.timestamp_millis(ts_ms)).withWatermark("_at", delay).drop("_at")


class SlidingLog(_Remembering):
    """Accepted times of a key, as far as a request that is not late can still see them: at most `per_hour` an hour."""

    STATE = "accepted array<bigint>"
    OUT = "key string, ts_ms long, request_id long, allowed boolean, late boolean"

    def __init__(self, per_minute: int, per_hour: int):
        self.per_minute, self.per_hour = per_minute, per_hour

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        asked, late = _in_time(rows, watermark, "request_id")
        known = self.recall()
        log = [t for t in known[0] if t > watermark - R.HOUR_MS] if known else []
        for at, request_id in asked:
            # What lies behind `at` counts too: so no window that holds it can exceed a limit.
            free = (len(log) - bisect_right(log, at - R.MINUTE_MS) < self.per_minute
                    and len(log) - bisect_right(log, at - R.HOUR_MS) < self.per_hour)
            if free:
                log.insert(bisect_right(log, at), at)
            yield Row(key=key[0], ts_ms=at, request_id=request_id, allowed=free, late=False)
        if log:
            self.keep((log,), log[-1] + R.HOUR_MS)
        for at, request_id in late:
            yield Row(key=key[0], ts_ms=at, request_id=request_id, allowed=None, late=True)


def rate_limit(requests: DataFrame, per_minute: int = R.PER_MINUTE, per_hour: int = R.PER_HOUR, delay: str = "5 minutes") -> DataFrame:
    """Sliding-log limit on a stream of requests(key, ts_ms, request_id): allowed, and late where it was not judged.

    A request is judged by what was accepted less than a minute and an hour before it.  One that comes behind others of
    its key, but not behind the watermark, also counts those, so that no minute or hour ever holds more than it may.
    """
    asked = watched(requests.select("key", "ts_ms", "request_id"), "ts_ms", delay)
    return asked.groupBy("key").transformWithState(SlidingLog(per_minute, per_hour), SlidingLog.OUT, "Append", "EventTime")


class MinuteCounts(_Remembering):
    """Requests of a client in each minute of one hour."""

    STATE = "minutes array<bigint>, counts array<bigint>"
    OUT = "key string, ts_ms long, request_id long, position long, allowed boolean, late boolean"

    def __init__(self, limit: int, delay_ms: int):
        self.limit, self.delay_ms = limit, delay_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, late = _in_time(rows, timerValues.getCurrentWatermarkInMs(), "request_id")
        known, any_asked = self.recall(), False
        counts = dict(zip(*known)) if known else {}
        for at, request_id in asked:
            minute, any_asked = at // R.MINUTE_MS, True
            position = counts[minute] = counts.get(minute, 0) + 1
            yield Row(key=key[0], ts_ms=at, request_id=request_id, position=position, allowed=position <= self.limit, late=False)
        if any_asked:
            self.keep((list(counts), list(counts.values())), (max(counts) + 1) * R.MINUTE_MS)
        for at, request_id in late:
            yield Row(key=key[0], ts_ms=at, request_id=request_id, position=None, allowed=None, late=True)


def fixed_minute(requests: DataFrame, limit: int = R.CLIENT_PER_MINUTE, delay_minutes: int = 5) -> DataFrame:
    """Clock-minute limit on a stream of requests(key, ts_ms, request_id): position in its minute, allowed, late.

    State is by client and hour, so a busy client is spread over tasks by time.
    """
    asked = watched(requests.select("key", "ts_ms", "request_id"), "ts_ms", f"{delay_minutes} minutes")
    by_hour = asked.withColumn("hour", F.floor(F.col("ts_ms") / R.HOUR_MS)).groupBy("key", "hour")
    return by_hour.transformWithState(MinuteCounts(limit, delay_minutes * R.MINUTE_MS), MinuteCounts.OUT, "Append", "EventTime")


JOB_BUCKETS = 1 << 13


class JobFold(_Remembering):
    """What the events of each job of a bucket say so far, and when it is due: while it runs, for its lock; else, for its end.

    A bucket has one row of state, a table of its jobs, and one timer, for the job that is due first.  So Spark is called for
    each bucket that a micro-batch touches, not for each job.
    """

    STATE = "bytes long, jobs binary"   # the table as Arrow writes it: how long it is, and compressed
    IN = ("job_id", "ts_ms", "seq", "kind", "worker", "error", "max_attempts")
    OUT = ("job_id string, version long, status string, attempts int, last_error string, locked_by string, locked_ms long, "
           "at_ms long, cause string, late boolean")
    _TABLE = pa.schema({
        "job_id": pa.string(), "version": pa.int64(), "ts_ms": pa.int64(), "seq": pa.int64(), "kind": pa.string(), "worker": pa.string(),
        "attempts": pa.int64(), "max_attempts": pa.int64(), "error": pa.string(), "error_ms": pa.int64(), "error_seq": pa.int64(),
        "expired": pa.bool_(), "until_ms": pa.int64()}.items())
    _NAMES = [f.split()[0] for f in OUT.split(", ")]
    # Where the fields of a job lie, behind its id.
    VERSION, TS, SEQ, KIND, WORKER, ATTEMPTS, MAX_ATTEMPTS, ERROR, ERROR_MS, ERROR_SEQ, EXPIRED, UNTIL = range(12)

    def __init__(self, lock_ms: int, keep_ms: int):
        self.lock_ms, self.keep_ms = lock_ms, keep_ms

    def jobs(self) -> dict:
        """The jobs of the bucket: id -> fields."""
        known = self.recall()
        if not known:
            return {}
        table = pa.ipc.read_record_batch(pa.decompress(bytes(known[1]), known[0], "zstd"), self._TABLE)
        ids, *fields = (c.to_pylist() for c in table.columns)
        return dict(zip(ids, map(list, zip(*fields))))

    def keep_jobs(self, jobs: dict, fired: bool = False) -> None:
        columns = zip(self._TABLE, [list(jobs), *zip(*jobs.values())])
        table = pa.RecordBatch.from_arrays([pa.array(values, field.type) for field, values in columns], schema=self._TABLE).serialize()
        self.keep((table.size, pa.compress(table, "zstd", asbytes=True)), min(job[self.UNTIL] for job in jobs.values()), fired)

    def status(self, job: list) -> str:
        if job[self.KIND] == "claim":
            return "queued" if job[self.EXPIRED] else "running"
        if job[self.KIND] == "complete":
            return "completed"
        return "failed" if job[self.KIND] == "fail" and job[self.ATTEMPTS] >= job[self.MAX_ATTEMPTS] else "queued"

    def row(self, job_id, job: list, status: str, at_ms: int, cause: str) -> tuple:
        running = status == "running"
        return (job_id, job[self.VERSION], status, job[self.ATTEMPTS], job[self.ERROR], job[self.WORKER] if running else None,
                job[self.TS] if running else None, at_ms, cause, False)

    def frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while part := list(islice(rows, _PART)):
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(self._NAMES, zip(*part))})

    def fold(self, job: list, ts_ms: int, seq: int, kind: str, worker: str, error: str, max_attempts: int) -> None:
        """One more event.  They may come in any order; of two at the same place the first counts."""
        job[self.ATTEMPTS] += kind == "claim"
        if max_attempts > job[self.MAX_ATTEMPTS]:
            job[self.MAX_ATTEMPTS] = max_attempts
        if kind == "fail" and (job[self.ERROR_MS] is None or (ts_ms, seq) > (job[self.ERROR_MS], job[self.ERROR_SEQ])):
            job[self.ERROR:self.EXPIRED] = error, ts_ms, seq
        if job[self.TS] is None or (ts_ms, seq) > (job[self.TS], job[self.SEQ]):
            job[self.TS:self.ATTEMPTS] = ts_ms, seq, kind, worker
            job[self.EXPIRED] = False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, jobs, touched = timerValues.getCurrentWatermarkInMs(), self.jobs(), {}
        for part in rows:
            late = []
            for job_id, ts_ms, *event in zip(*(part[c].tolist() for c in self.IN)):
                if ts_ms < watermark:
                    late.append((job_id, None, None, None, None, None, None, ts_ms, event[1], True))
                    continue
                job = touched.get(job_id)
                if job is None:
                    job = touched[job_id] = jobs.setdefault(job_id, [0, None, None, None, None, 0, 0, None, None, None, False, None])
                self.fold(job, ts_ms, *event)
            yield from self.frames(iter(late))
        if touched:
            yield from self.frames(map(self.moved, touched, touched.values()))
            self.keep_jobs(jobs)

    def moved(self, job_id, job: list) -> tuple:
        """A job after events.  One that waits for a worker has nothing to be woken for; it is forgotten when it was left for long."""
        status = self.status(job)
        job[self.VERSION] += 1
        job[self.UNTIL] = job[self.TS] + (self.lock_ms if status == "running" else self.keep_ms)
        return self.row(job_id, job, status, job[self.TS], job[self.KIND])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, jobs, freed = timerValues.getCurrentWatermarkInMs(), {}, []
        for job_id, job in self.jobs().items():
            if job[self.UNTIL] <= watermark:
                if self.status(job) != "running":
                    continue  # it is forgotten
                job[self.EXPIRED], job[self.UNTIL] = True, job[self.TS] + self.lock_ms + self.keep_ms
                job[self.VERSION] += 1
                freed.append(self.row(job_id, job, "queued", job[self.TS] + self.lock_ms, "lock expired"))
            jobs[job_id] = job
        if jobs:
            self.keep_jobs(jobs, fired=True)
        else:
            self.forget()
        yield from self.frames(iter(freed))


def job_states(events: DataFrame, lock_minutes: int = 10, keep_hours: int = 24, delay: str = "5 minutes", buckets: int = JOB_BUCKETS) -> DataFrame:
    """Every state that jobs go through, from the stream of their events(job_id, ts, seq, kind, worker, error, max_attempts).

    A row per job and micro-batch with events of it, with a growing version.  When the watermark passes the time to live of
    a lock, a row with status queued and cause `lock expired` is put out without any event.  A job that nothing was heard
    of for `keep_hours`, finished ones among them, leaves the state; events behind the watermark come back marked late.

    Jobs lie in `buckets` by a hash of their id, a row of state each.  A micro-batch reads and writes the buckets that it
    touches whole, some 40 bytes for each job in them; so a stream of far more open jobs wants more buckets.  Their number
    can't change while a stream keeps its state.
    """
    needed = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"a job event without {what}")))
    rows = watched(events.select("job_id", needed(F.unix_millis("ts"), "a time").alias("ts_ms"), F.coalesce("seq", F.lit(-1 << 31)).alias("seq"), "kind",
                                 "worker", "error", needed(F.col("max_attempts"), "the most attempts").alias("max_attempts")), "ts_ms", delay)
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    return bucketed.groupBy("bucket").transformWithStateInPandas(
        JobFold(lock_minutes * 60_000, keep_hours * R.HOUR_MS), JobFold.OUT, "Append", "EventTime")


def newest_states(states: DataFrame) -> DataFrame:
    """The last state of each job that is not late."""
    rest = ["status", "attempts", "last_error", "locked_by", "locked_ms", "at_ms", "cause"]
    last = states.where("NOT late").groupBy("job_id").agg(*[F.max_by(c, "version").alias(c) for c in rest])
    return last.select("job_id", *rest)


class Sessions(_Remembering):
    """Open sessions of an id, each closed when the watermark is `gap` past its last event."""

    STATE = "events array<bigint>, starts array<bigint>, ends array<bigint>"
    OUT = "session_id string, events long, start_ms long, end_ms long, late boolean"

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, events = timerValues.getCurrentWatermarkInMs(), array("q")
        for row in rows:
            if row.ts_ms < watermark:
                yield Row(session_id=key[0], events=1, start_ms=row.ts_ms, end_ms=row.ts_ms, late=True)
            else:
                events.append(row.ts_ms)
        if events:
            counts, starts, ends = self.recall() or ([], [], [])
            merged: list[list[int]] = []
            for start, end, n in merge(sorted(zip(starts, ends, counts)), ((t, t, 1) for t in np.sort(events).tolist())):
                if merged and start - merged[-1][1] < self.gap_ms:
                    merged[-1] = [merged[-1][0], max(merged[-1][1], end), merged[-1][2] + n]
                else:
                    merged.append([start, end, n])
            self._keep_open(merged)

    def _keep_open(self, sessions: list, fired: bool = False) -> None:
        starts, ends, counts = map(list, zip(*sessions))
        self.keep((counts, starts, ends), ends[0] + self.gap_ms, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        counts, starts, ends = self.recall()
        past = timerValues.getCurrentWatermarkInMs() - self.gap_ms
        sessions = sorted(zip(starts, ends, counts))
        closed, rest = [s for s in sessions if s[1] <= past], [s for s in sessions if s[1] > past]
        if rest:
            self._keep_open(rest, fired=True)
        else:
            self.forget()
        for start, end, n in closed:
            yield Row(session_id=key[0], events=n, start_ms=start, end_ms=end, late=False)


def sessions_by_id(events: DataFrame, gap: str = "24 hours", delay: str = "5 minutes") -> DataFrame:
    """Sessions of a stream of events(session_id, ts_ms), put out once, when nothing was heard of them for `gap`.

    An event behind the watermark is a late row of its own; an id that comes back after its session was closed begins a
    new one.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = watched(events.select("session_id", "ts_ms"), "ts_ms", delay)
    return rows.groupBy("session_id").transformWithState(Sessions(gap_ms), Sessions.OUT, "Append", "EventTime")

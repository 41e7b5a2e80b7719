"""Rate limits: sliding log per key, fixed minute per client, and current usage."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .timeline import sliding_counts

MINUTE_MS, HOUR_MS = 60_000, 3_600_000
PER_MINUTE, PER_HOUR, CLIENT_PER_MINUTE = 10, 100, 100


def usage(requests: DataFrame, key: str = "key", ts_ms: str = "ts_ms") -> DataFrame:
    """Per (key, instant): requests in the last minute and in the last hour, that instant included."""
    return sliding_counts(requests, key, ts_ms, {"minute": MINUTE_MS, "hour": HOUR_MS})


PIECE_ROWS, PIECES = 200_000, 32     # a run of so many instants is walked in two pieces, and so on up to 32
WARM_MS = 2 * HOUR_MS                # what is walked before a piece to guess the log it starts with
WALKED = "key string, run bigint, piece bigint, ts_ms bigint, accepted bigint, before array<bigint>, after array<bigint>"


def _walk_pieces(per_minute: int, per_hour: int):
    """Walk the instants of pieces in time order; keep only the accepted times of the last hour.

    Each piece comes with a head (its start, the next one's, and the log to start with), then instants, those before its
    start only to warm up.  Out come its instants with how many are accepted, and, without an instant, the log before and
    after it.
    """
    def trimmed(log, moment):
        return [t for t in log if t > moment - HOUR_MS]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, log, start, stop, before = None, deque(), 0, 0, None

        def end():
            known = trimmed(log, start) if before is None else before
            return (*owner, None, None, known, trimmed(log, stop))

        for batch in batches:
            out = []
            for key, run, piece, ms, n, head, begin, until in batch.itertuples(index=False):
                if head is not None:
                    if owner:
                        out.append(end())
                    owner, log, start, stop, before = (key, run, piece), deque(head), int(begin), int(until), None
                    continue
                ms, n = int(ms), int(n)
                if ms >= start and before is None:
                    before = trimmed(log, start)
                while log and ms - log[0] >= HOUR_MS:
                    log.popleft()
                last_minute = 0
                for earlier in reversed(log):
                    if ms - earlier >= MINUTE_MS:
                        break
                    last_minute += 1
                taken = max(0, min(n, per_minute - last_minute, per_hour - len(log)))
                log.extend([ms] * taken)
                if ms >= start:
                    out.append((key, run, piece, ms, taken, None, None))
            frame = pd.DataFrame(out, columns=["key", "run", "piece", "ts_ms", "accepted", "before", "after"])
            yield frame.astype({"ts_ms": "Int64", "accepted": "Int64"})
        if owner:
            yield pd.DataFrame([end()], columns=["key", "run", "piece", "ts_ms", "accepted", "before", "after"]).astype(
                {"ts_ms": "Int64", "accepted": "Int64"})
    return fold


def in_pieces(walk: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The instants of runs (key, run, ts_ms, n) with their piece, and the pieces (key, run, piece, start, stop), which
    cut the time of a run evenly."""
    whole = walk.groupBy("key", "run").agg(F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("last"), F.count("*").alias("_rows")).withColumn(
        "size", F.expr(f"(last - from_ms) div least({PIECES}, _rows div {piece_rows} + 1) + 1")).drop("_rows")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(last - from_ms) div size")))).select(
        "key", "run", "piece", (F.col("from_ms") + F.col("piece") * F.col("size")).alias("start"),
        (F.col("from_ms") + (F.col("piece") + 1) * F.col("size")).alias("stop"))
    placed = walk.join(whole, ["key", "run"]).withColumn("piece", F.expr("(ts_ms - from_ms) div size"))
    return placed.select("key", "run", "piece", "ts_ms", "n", (F.col("from_ms") + (F.col("piece") + 1) * F.col("size")).alias("stop")), pieces


def by_piece(rows: DataFrame) -> DataFrame:
    """Dealt by piece to as many tasks as shuffles have: a walk costs more than its few bytes, by which tasks are merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "run", "piece")


def walk_runs(walk: DataFrame, per_minute: int, per_hour: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """key, ts_ms, accepted of the instants of runs, whose pieces are walked side by side.

    A piece needs the log that the one before it leaves.  At first that is guessed by walking the two hours before it;
    pieces whose guess was not what the piece before them left are walked again with that, until none is left.  The first
    piece of a run starts with an empty log, so what agrees all along is exact.  Logs that do not forget where they began
    take up to as many rounds as a run has pieces; each round's pieces are bounded, and none holds a whole run.
    """
    rows, pieces = (written(df, "rate-pieces") for df in in_pieces(walk, piece_rows))
    empty = F.array().cast("array<bigint>")
    heads = pieces.select("key", "run", "piece", F.lit(None).cast("bigint").alias("ts_ms"), F.lit(None).cast("bigint").alias("n"),
                          empty.alias("log"), "start", "stop")
    instant = lambda df: df.select("key", "run", "piece", "ts_ms", "n", F.lit(None).cast("array<bigint>").alias("log"),
                                   F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"))
    warm = rows.filter(F.col("ts_ms") >= F.col("stop") - WARM_MS).withColumn("piece", F.col("piece") + 1).join(
        pieces.select("key", "run", "piece"), ["key", "run", "piece"], "left_semi")
    read, results, latest, turn = instant(rows).unionByName(instant(warm)), [], None, 0
    where = ["key", "run", "piece"]
    while True:
        walked = written(by_piece(heads.unionByName(read)).sortWithinPartitions(*where, F.col("ts_ms").asc_nulls_first())
                         .mapInPandas(_walk_pieces(per_minute, per_hour), WALKED), "rate-walked")
        results.append(walked.filter("ts_ms IS NOT NULL").withColumn("turn", F.lit(turn)))
        ends = walked.filter("ts_ms IS NULL").select(*where, "before", "after", F.lit(turn).alias("turn"))
        latest = ends if latest is None else written(latest.join(ends, where, "left_anti").unionByName(ends), "rate-ends")
        left = latest.select("key", "run", (F.col("piece") + 1).alias("piece"), F.col("after").alias("log"))
        wrong = latest.join(left, where).filter("before <> log").join(pieces, where)
        if wrong.isEmpty():
            break
        turn += 1
        heads = written(wrong.select(*where, F.lit(None).cast("bigint").alias("ts_ms"), F.lit(None).cast("bigint").alias("n"), "log", "start", "stop"), "rate-heads")
        read = instant(rows.join(heads.select(*where), where, "left_semi"))
    if turn == 0:
        return results[0].select("key", "ts_ms", "accepted")
    every = reduce(DataFrame.unionByName, results)
    return every.join(latest.select(*where, "turn"), [*where, "turn"]).select("key", "ts_ms", "accepted")


def sliding_log(requests: DataFrame, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR,
                piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Accept or deny each request(key, ts_ms, request_id); a denied request does not count later.

    Whether a request is accepted depends on earlier acceptances, but only where the *raw* counts
    exceed a limit.  Everything else is accepted inside the JVM.  The rest falls into runs of
    contested instants less than an hour apart; what precedes a run by an hour was all accepted, so
    each run starts from a known state and runs are independent of each other.  A run of many instants
    is walked in pieces by several tasks, streaming, on rows already reduced to one per (key, instant), with at most
    `per_hour` remembered times; a saturated key therefore costs by its time span, not by its rows.
    """
    counted = written(usage(requests.select("key", "ts_ms")), "rate-usage")
    is_contested = (F.col("minute") > per_minute) | (F.col("hour") > per_hour)
    instants = counted.select("key", "ts_ms", "n", is_contested.alias("contested"),
                              F.floor(F.col("ts_ms") / HOUR_MS).alias("bucket"))
    # One row per hour with a contested instant; a run is a chain of them less than an hour apart.
    hours = instants.filter("contested").groupBy("key", "bucket").agg(
        F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    along = Window.partitionBy("key").orderBy("bucket")
    new_run = F.coalesce((F.col("first") - F.lag("last").over(along) >= HOUR_MS).cast("int"), F.lit(1))
    runs = (hours.withColumn("_new", new_run)
            .withColumn("run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("from_ms", F.when(F.col("_new") == 1, F.col("first") - HOUR_MS + 1)
                        .otherwise(F.col("bucket") * HOUR_MS)))
    # Instants a run reads: its own hours, and before its first contested one the hour leading to it.
    own = runs.select("key", "bucket", "run", "from_ms")
    lead_in = runs.filter("_new = 1").select("key", (F.col("bucket") - 1).alias("bucket"), "run", "from_ms")
    walk = (instants.join(own.unionByName(lead_in), ["key", "bucket"])
            .filter(F.col("ts_ms") >= F.col("from_ms")).select("key", "run", "ts_ms", "n"))
    # from_ms lies after every contested instant of an earlier run, so runs do not see each other.
    folded = walk_runs(walk, per_minute, per_hour, piece_rows)
    # An uncontested instant may be walked by two runs, a contested one only by its own.
    contested = instants.filter("contested").select("key", "ts_ms").join(folded, ["key", "ts_ms"])
    verdict = instants.join(contested, ["key", "ts_ms"], "left").select(
        "key", "ts_ms", F.coalesce("accepted", "n").alias("accepted"))
    rank = F.row_number().over(Window.partitionBy("key", "ts_ms").orderBy("request_id"))
    return (requests.join(verdict, ["key", "ts_ms"])
            .withColumn("allowed", rank <= F.col("accepted")).drop("accepted"))


def fixed_minute(requests: DataFrame, limit: int = CLIENT_PER_MINUTE) -> DataFrame:
    """The first `limit` requests of a client in each clock minute are allowed.

    Requests are ranked inside their instant and shifted by what came earlier in the minute, so no
    task ever sees more than one instant of one client.
    """
    minute = F.floor(F.col("ts_ms") / MINUTE_MS)
    instants = requests.groupBy("key", "ts_ms").agg(F.count(F.lit(1)).alias("n"))
    earlier = (Window.partitionBy("key", minute).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, -1))
    before = instants.select("key", "ts_ms", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "ts_ms").orderBy("request_id"))
    return (requests.join(before, ["key", "ts_ms"])
            .withColumn("position", (F.col("before") + rank).cast("bigint"))
            .withColumn("allowed", F.col("position") <= limit).drop("before"))

"""Language-model scores by deleted interpolation of n-gram estimates.

    P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1),   l0 + l1 + l2 = 1 for each bucket of c(v)

The weights are learned by expectation-maximisation on counts held out from the estimates: a tenth of the training
documents is deleted from all counts, and their words are predicted by what remains.

Counts stay distributed throughout.  Documents are encoded in blocks; a block sends each distinct word and pair of words
once, with its own counts, to the slice that owns the key.  The owner adds up and answers only for keys that two or more
blocks share; for all others the block already has the whole count.  Blocks are kept in a bucketed table, so that answers
come to the blocks and not the other way round.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path, written
from .common import cores

BLOCK_TOKENS = 1_000_000  # a task needs about 150 bytes for each
SLICE_BYTES = 64 << 20     # text per slice of keys; small inputs have eight slices per core
FOLDS, HELD_OUT = 7, 2     # documents whose crc32(doc_id) mod 7 is 2 are not learned from
DEV = 10                   # one training document in ten is deleted from the counts that the weights are learned by
ROUNDS = 60                # of expectation-maximisation

_START, _END = 0x243F6A8885A308D3, 0x13198A2E03707344

BLOCKS = "block long, doc_id array<long>, held array<boolean>, dev array<boolean>, words array<int>, vocabulary binary, tokens binary"
KEYS = "slice int, block long, keys binary, counts binary, dev_counts binary"
ANSWERS = "block long, slice int, places binary, counts binary, dev_counts binary, types long, total long, dev_total long"


def held_out(doc_id: Column) -> Column:
    """A null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _shrink(values) -> bytes:
    """Integers by planes of bytes, so that high bytes cost little."""
    import numpy as np

    return zlib.compress(np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T).tobytes(), 1)


def _grow(data: bytes, kind: str):
    import numpy as np

    flat, width = np.frombuffer(zlib.decompress(data), "u1"), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).ravel()


def _small(values):
    """Counts in the narrowest unsigned type; its width is kept in front."""
    import numpy as np

    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + _shrink(values.astype(kind))


def _counts(data: bytes):
    return _grow(data[1:], f"u{data[0]}").astype("i8")


def _spread(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def encode_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Whole texts as numbers of words, in blocks of documents: A-Z in lower case, words between ASCII white space.

    The vocabulary of a block lists the hashes of its words, the most frequent first.
    """
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        first, made = TaskContext.get().partitionId() << 20, 0
        known, tokens, docs, size = {}, [], [], 0

        def block():
            flat = np.concatenate([*tokens, np.empty(0, "i4")])
            often = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), "i4")
            rank[often] = np.arange(len(known), dtype="i4")
            hashes = np.fromiter((xxh64_intdigest(w) for w in known), "u8", len(known))[often]
            columns = list(zip(*docs))
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, kinds)),
                 pa.array([hashes.tobytes()]), pa.array([_shrink(rank[flat])])],
                names=["block", "doc_id", "held", "dev", "words", "vocabulary", "tokens"])

        for batch in batches:
            for doc_id, held, dev, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "dev")), batch.column("text")):
                text = text.as_py()
                words = text.encode().lower().split() if text else []
                tokens.append(np.array([known.setdefault(w, len(known)) for w in words], "i4"))
                docs.append((doc_id, held, dev, len(words)))
                size += len(words) + 1
                if size >= block_tokens:
                    yield block()
                    made, known, tokens, docs, size = made + 1, {}, [], [], 0
        if docs:
            yield block()

    dev = F.pmod(F.xxhash64(F.lit("dev"), F.col("doc_id").cast("string")), F.lit(DEV)) == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"),
                       (dev & ~held_out(F.col("doc_id"))).alias("dev"), "text").mapInArrow(work, BLOCKS)


class Block:
    """The words and pairs of a block, with its own counts, in the order of their keys."""

    def __init__(self, row: dict):
        import numpy as np

        words = np.array(row["words"], "i8")
        vocabulary = np.concatenate([np.frombuffer(row["vocabulary"], "u8"), np.array([_END, _START], "u8")])
        n, end = len(vocabulary), len(vocabulary) - 2
        tokens = _grow(row["tokens"], "i4")
        self.lengths = words + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        stops = self.starts + words
        # What is predicted: the words, then an end.  What it is predicted from: a start, then the words.
        self.word = np.full(self.lengths.sum(), end, "i4")
        inside = np.ones(len(self.word), bool)
        inside[stops] = False
        self.word[inside] = tokens
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.starts] = end + 1
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.dev = np.repeat(np.array(row["dev"], bool), self.lengths)
        pairs, pair = np.unique(self.before.astype("i8") * n + self.word, return_inverse=True)
        self.pair = pair.astype("i4")
        del pair
        ones = vocabulary * np.uint64(0x9E3779B97F4A7C15)
        single = _spread(ones) | np.uint64(1)
        single[-1] &= ~np.uint64(1)  # the start is no word
        double = _spread(ones[pairs // n] * np.uint64(0xBF58476D1CE4E5B9) + ones[pairs % n] + np.uint64(1)) & ~np.uint64(1)
        keys = np.concatenate([single, double])
        self.order = np.argsort(keys)
        self.keys, self.n_single = keys[self.order], n

        def count(weight):
            one = np.bincount(self.word[weight], minlength=n)
            one[-1] = np.count_nonzero(weight[self.starts])
            return np.concatenate([one, np.bincount(self.pair[weight], minlength=len(pairs))])[self.order]

        self.counts, self.dev_counts = count(self.train), count(self.dev)

    def edges(self, slices: int):
        """Where each slice begins in the order of keys."""
        import numpy as np

        at = (self.keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        return np.searchsorted(at, np.arange(slices + 1))

    def settle(self, answers: list[dict], slices: int) -> None:
        """Whole counts in place of the block's own; then by word and by pair."""
        import numpy as np

        edges = self.edges(slices)
        for answer in answers:
            places = edges[answer["slice"]] + np.cumsum(_grow(answer["places"], "u4").astype("i8"))
            self.counts[places] = _counts(answer["counts"])
            self.dev_counts[places] = _counts(answer["dev_counts"])
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(back))
        counts, dev = self.counts[back], self.dev_counts[back]
        self.ones, self.pairs = counts[:self.n_single], counts[self.n_single:]
        self.dev_ones, self.dev_pairs = dev[:self.n_single], dev[self.n_single:]


def _rows(batch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def answers(blocks: DataFrame, slices: int) -> DataFrame:
    """For each block and slice the whole counts of keys that other blocks have too; with block -1, totals of the slice."""
    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in _rows(batch):
                own = Block(row)
                edges = own.edges(slices)
                out = [(k, row["block"], _shrink(own.keys[a:b]), _small(own.counts[a:b]), _small(own.dev_counts[a:b]))
                       for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=["slice", "block", "keys", "counts", "dev_counts"])

    def answer(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["block", "slice", "places", "counts", "dev_counts", "types", "total", "dev_total"]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def close(number, rows):
            parts = [_grow(r[1], "u8") for r in rows]
            keys, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            total = np.add.reduceat(np.concatenate([_counts(r[2]) for r in rows])[order], begins)
            dev = np.add.reduceat(np.concatenate([_counts(r[3]) for r in rows])[order], begins)
            word = (ranked[begins] & np.uint64(1)) == 1
            group = np.empty(len(keys), "i8")
            group[order] = np.repeat(np.arange(len(begins)), np.diff([*begins, len(keys)]))
            shared = np.diff([*begins, len(keys)]) > 1
            out = [(-1, number, None, None, None, int((word & (total > 0)).sum()), int(total[word].sum()), int(dev[word].sum()))]
            for row, low, high in zip(rows, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
                of = group[low:high]
                places = np.flatnonzero(shared[of])
                if len(places):
                    of = of[places]
                    out.append((row[0], number, _shrink(np.diff(places, prepend=0).astype("u4")), _small(total[of]),
                                _small(dev[of]), None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        number, held = None, []
        for batch in batches:
            for row in _rows(batch):
                if held and row["slice"] != number:
                    yield close(number, held)
                    held = []
                number = row["slice"]
                held.append((row["block"], row["keys"], row["counts"], row["dev_counts"]))
        if held:
            yield close(number, held)

    return blocks.mapInArrow(ask, KEYS).repartition("slice").sortWithinPartitions("slice", "block").mapInArrow(answer, ANSWERS)


def fit_weights(cells: list[tuple[int, float, float, float]], uniform: float):
    """bucket -> (l2, l1, l0) by expectation-maximisation; cells are (bucket, p2, p1, how often).

    A bucket starts from even weights with one imagined observation of each kind, so no weight becomes zero.
    """
    import numpy as np

    weights = {}
    for bucket in sorted({c[0] for c in cells}):
        p2, p1, n = np.array([c[1:] for c in cells if c[0] == bucket]).T
        parts = np.stack([p2, p1, np.full_like(p1, uniform)])
        mix = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = mix[:, None] * parts
            share /= share.sum(0)
            mix = (share * n).sum(1) + np.array([float(bucket > 0), 1.0, 1.0])
            mix /= mix.sum()
        weights[bucket] = tuple(float(m) for m in mix)
    return weights


def _bucket(count):
    """0 for contexts never seen, else one more than the binary logarithm of the count."""
    import numpy as np

    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype("f8"))[1], 0)


def score_texts(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, slices: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs (doc_id, text).

    The tokens of a text are its words and an end; a null text has only the end.  base_score is the text's log10
    probability under add-one unigrams, score that under the interpolated model.  Rows with a null id are learned from.
    Repeated rows count, and are scored, each.  `slices` should be such that a slice's keys fit a task's memory; by
    default it grows with the bytes of text.
    """
    spark = docs.sparkSession
    if slices is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slices = max(8 * cores(spark), -(-size // SLICE_BYTES))
    # A table bucketed by block: both joins below move only the answers.
    name = f"lm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encode_blocks(docs, block_tokens).write.bucketBy(buckets, "block").sortBy("block") \
        .option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    found = written(answers(blocks, slices), "answers")
    totals = found.where("block = -1").agg(F.sum("types"), F.sum("total"), F.sum("dev_total")).first()
    types, total, dev_total = (int(t or 0) for t in totals)
    uniform = 1.0 / (types + 1)
    replies = found.where("block >= 0").groupBy("block").agg(
        F.collect_list(F.struct("slice", "places", "counts", "dev_counts")).alias("answers"))
    settled = blocks.join(replies, "block", "left")

    def deleted(batches: Iterator) -> Iterator:
        """How often each cell of (bucket, p2, p1) was seen in the deleted documents; p in quarters of a power of two."""
        import numpy as np
        import pyarrow as pa

        def level(p):
            return np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300))), 1).astype("i8")

        for batch in batches:
            for row in _rows(batch):
                own = Block(row)
                own.settle(row["answers"] or [], slices)
                word, before, pair = own.word[own.dev], own.before[own.dev], own.pair[own.dev]
                seen = own.ones[before] - own.dev_ones[before]
                both = own.pairs[pair] - own.dev_pairs[pair]
                p2 = np.where(seen > 0, both / np.maximum(seen, 1), 0.0)
                p1 = (own.ones[word] - own.dev_ones[word]) / max(total - dev_total, 1)
                cells = np.stack([_bucket(seen), level(p2), level(p1)], 1)
                cells, times = np.unique(cells, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(cells[:, k]) for k in range(3)), pa.array(times.astype("i8"))],
                                                 names=["bucket", "p2", "p1", "n"])

    # Cells are levels of logarithms: their number has a bound that does not depend on the corpus.
    cells = settled.mapInArrow(deleted, "bucket long, p2 long, p1 long, n long").groupBy("bucket", "p2", "p1").agg(
        F.sum("n").alias("n")).collect()
    power = {k: 0.0 if k > 0 else 2.0 ** (k / 4) for k in {c["p2"] for c in cells} | {c["p1"] for c in cells}}
    weights = fit_weights([(int(c["bucket"]), power[c["p2"]], power[c["p1"]], float(c["n"])) for c in cells], uniform)

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.full((66, 3), np.nan)
        for bucket in range(66):  # a bucket without deleted words takes the weights of the nearest one that has some
            near = min(weights, key=lambda b: (abs(b - bucket), b), default=None)
            table[bucket] = (0.0, 0.5, 0.5) if near is None else weights[near]
        for batch in batches:
            for row in _rows(batch):
                own = Block(row)
                own.settle(row["answers"] or [], slices)
                once, seen, both = own.ones[own.word], own.ones[own.before], own.pairs[own.pair]
                mix = table[_bucket(seen)]
                p = mix[:, 0] * both / np.maximum(seen, 1) + mix[:, 1] * once / max(total, 1) + mix[:, 2] * uniform
                base = np.log10((once + 1) / (total + types + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(own.lengths),
                    pa.array(np.add.reduceat((once > 0).astype("i8"), own.starts)),
                    pa.array(np.full(len(own.lengths), total, "i8")), pa.array(np.add.reduceat(base, own.starts)),
                    pa.array(np.add.reduceat(np.log10(p), own.starts))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return settled.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double")

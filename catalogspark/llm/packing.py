"""Best-fit packing of token sequences: a grouping genetic algorithm on islands, over blocks of bounded size."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from random import Random

from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import IdEncoder, cores, encoder

BLOCK = 4096        # pieces that are packed together
ENCODED = 1 << 24   # bytes of text that are encoded together
ISLANDS = 2
EPOCHS = 2          # migrations happen between epochs
POPULATION = 4
GENERATIONS = 50    # children in a row without a better plan that end an epoch
PAIRS = 128         # pairs of pieces that a child tries to exchange
_BINS = 1 << 16     # sequence numbers within a block

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces of every whole text: doc_id, piece, start, length, ids_crc32.

    A document is its token ids, special tokens not added, then `end_id`; a null text is the empty text and so one
    token.  Only what is longer than `capacity` is cut, every `capacity` tokens.  Texts never leave their task.
    """
    def cut(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        model, end, width = encoder(IdEncoder, tokenizer_path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            # Slices of some ENCODED bytes: a row count would make them small for short texts and large for long ones.
            texts = batch.column("text").fill_null("")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64")
            starts = np.flatnonzero(np.diff(sizes // ENCODED, prepend=-1)).tolist()
            for low, high in zip(starts, [*starts[1:], batch.num_rows]):
                codes = model.encode(texts.slice(low, high - low))
                for doc_id, code in zip(batch.column("doc_id").slice(low, high - low).to_pylist(), codes):
                    code += end
                    for number, start in enumerate(range(0, len(code), width)):
                        piece = code[start:start + width]
                        rows.append((doc_id, number, start // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


# ---- one block on one island --------------------------------------------------------------------------------

def best_fit(items, lengths, bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Puts each item, in the order given, into the fullest bin that has room, or into a new one."""
    width = len(lengths) + len(bins) + 1
    room = sorted((capacity - fill) * width + b for b, fill in enumerate(fills) if fill < capacity)
    for i in items:
        at = bisect_left(room, lengths[i] * width)
        if at < len(room):
            free, b = divmod(room.pop(at), width)
        else:
            free, b = capacity, len(bins)
            bins.append([])
            fills.append(0)
        bins[b].append(i)
        fills[b] += lengths[i]
        if free > lengths[i]:
            insort(room, (free - lengths[i]) * width + b)


def packed(order, lengths, capacity):
    bins, fills = [], []
    best_fit(order, lengths, bins, fills, capacity)
    return bins, fills


def fitness(plan, capacity):
    """Fewer bins first; among equals the one whose bins are filled most unevenly, as it leaves more room to gather."""
    bins, fills = plan
    return -len(bins), sum((f / capacity) ** 2 for f in fills)


def exchange(displaced, lengths, bins, fills, capacity, random: Random) -> list[int]:
    """Bins that are not full give one or two pieces for one or two of `displaced` that fill them better; what is left
    outside is smaller and so easier to place (Falkenauer's replacement).  Returns what is left."""
    import numpy as np

    pool = sorted((lengths[i], i) for i in displaced)

    def swap(b, out, into):
        for i in out:
            bins[b].remove(i)
            fills[b] -= lengths[i]
        for n, i in into:
            del pool[bisect_left(pool, (n, i))]
            bins[b].append(i)
            fills[b] += n
        for i in out:
            insort(pool, (lengths[i], i))

    slack = [b for b, fill in enumerate(fills) if fill < capacity]
    for b in slack:
        for i in list(bins[b]):
            at = bisect_left(pool, (lengths[i] + capacity - fills[b] + 1,)) - 1
            if at >= 0 and pool[at][0] > lengths[i]:
                swap(b, [i], [pool[at]])
    # Pairs cost more: a child tries PAIRS of them, other children others.
    slack = [b for b in slack if fills[b] < capacity and len(bins[b]) > 1]
    for b in random.sample(slack, min(PAIRS, len(slack))):
        if len(pool) < 2:
            break
        out = random.sample(bins[b], 2)
        room = capacity - fills[b] + lengths[out[0]] + lengths[out[1]]
        sizes = np.array([n for n, _ in pool])
        mates = np.minimum(np.searchsorted(sizes, room - sizes, "right") - 1, np.arange(len(sizes)) - 1)
        sums = np.where(mates >= 0, sizes + sizes[mates], -1)
        at = int(sums.argmax())
        if room >= sums[at] > lengths[out[0]] + lengths[out[1]]:
            swap(b, out, [pool[at], pool[int(mates[at])]])
    return [i for _, i in pool]


def crossover(one, other, lengths, capacity, random: Random):
    """Whole well-filled bins of `other` go into `one`; bins of `one` that share an item with them are dissolved, and
    what they held besides is put back, by exchange for smaller pieces and then by best fit, largest first."""
    ranked = sorted(range(len(other[0])), key=lambda b: -other[1][b])
    well = ranked[:max(1, len(ranked) // 2)]
    chosen = [b for b in well if random.random() < 0.5] or well[:1]
    injected = [other[0][b] for b in chosen]
    inside = {i for b in injected for i in b}
    bins, fills, displaced = [list(b) for b in injected], [other[1][b] for b in chosen], []
    for b, fill in zip(*one):
        if inside.isdisjoint(b):
            bins.append(list(b))
            fills.append(fill)
        else:
            displaced += [i for i in b if i not in inside]
    # Some bins more are dissolved, the emptiest more often, so that like parents have other children.
    emptiest = sorted(range(len(bins)), key=lambda b: fills[b] * random.random())[:max(2, len(bins) // 50)]
    for b in sorted(emptiest, reverse=True):
        displaced += bins.pop(b)
        fills.pop(b)
    displaced = exchange(displaced, lengths, bins, fills, capacity, random)
    displaced.sort(key=lambda i: (-lengths[i], i))
    best_fit(displaced, lengths, bins, fills, capacity)
    return bins, fills


def least_bins(lengths, capacity: int) -> int:
    """No plan has fewer bins: pieces beyond half a bin never share one, and those that are too long to join a piece of
    a given least length leave no room to pieces of that length or more (Martello and Toth)."""
    ordered, sums = sorted(lengths), [0]
    for n in ordered:
        sums.append(sums[-1] + n)
    half, least = bisect_right(ordered, capacity // 2), -(-sums[-1] // capacity)
    for low, n in enumerate(ordered[:half]):
        if low and ordered[low - 1] == n:
            continue
        alone = max(half, bisect_right(ordered, capacity - n))     # beyond it no piece has room for n more
        room = (alone - half) * capacity - (sums[alone] - sums[half])
        least = max(least, len(ordered) - half + max(0, -((room - (sums[half] - sums[low])) // capacity)))
    return max(least, len(ordered) - half)


def evolve(lengths: list[int], capacity: int, arrived: list[list[int]], seed: int, generations: int = GENERATIONS):
    """The best plan of an island after an epoch, as the bin of each item.  `arrived`: its own elite and the migrants.

    An epoch ends with a plan that meets the bound, or after `generations` children in a row of which none was better
    than the best plan before it; as long as they get better, it goes on.
    """
    random, least = Random(seed), least_bins(lengths, capacity)

    def unfold(assigned):
        bins = [[] for _ in range(max(assigned, default=-1) + 1)]
        for i, b in enumerate(assigned):
            bins[b].append(i)
        return bins, [sum(lengths[i] for i in b) for b in bins]

    people = [unfold(list(a)) for a in arrived]
    if not people:
        largest_first = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        people = [packed(largest_first, lengths, capacity)]
    best = max(people, key=lambda p: fitness(p, capacity))
    while len(best[0]) > least and len(people) < POPULATION:
        noise = [n * random.uniform(0.7, 1.3) for n in lengths]
        people.append(packed(sorted(range(len(lengths)), key=lambda i: -noise[i]), lengths, capacity))
        best = max(best, people[-1], key=lambda p: fitness(p, capacity))
    vain = 0
    while len(best[0]) > least and vain < generations:
        one, other = random.sample(people, 2)
        child = crossover(one, other, lengths, capacity, random)
        worst = min(range(len(people)), key=lambda k: fitness(people[k], capacity))
        if fitness(child, capacity) > fitness(people[worst], capacity):
            people[worst] = child
        better = fitness(child, capacity) > fitness(best, capacity)
        best, vain = (child, 0) if better else (best, vain + 1)
    assigned = [0] * len(lengths)
    for b, items in enumerate(best[0]):
        for i in items:
            assigned[i] = b
    return assigned


# ---- blocks as a Spark job -------------------------------------------------------------------------------------

def cut_blocks(pieces: DataFrame, block: int) -> DataFrame:
    """Rows of at most `block` pieces each: block, items (the pieces' rows), lengths.

    Pieces are dealt out evenly; a task gathers `block` rows at a time and shares out its last ones, so blocks are
    bounded whatever the partition's size, and of like size.
    """
    names = pieces.columns
    item = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        first, number, held = TaskContext.get().partitionId() << 20, 0, []

        def rows(table, count):
            nonlocal number
            for k in range(count):
                low, high = k * table.num_rows // count, (k + 1) * table.num_rows // count
                part = table.slice(low, high - low).combine_chunks()
                values = pa.StructArray.from_arrays([part.column(n).combine_chunks() for n in names], names=names)
                ends = pa.array([0, len(values)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + number], pa.int64()), pa.ListArray.from_arrays(ends, values),
                     pa.ListArray.from_arrays(ends, values.field("length"))], names=["block", "items", "lengths"])
                number += 1

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * block:
                table = pa.Table.from_batches(held)
                yield from rows(table.slice(0, block), 1)
                held = table.slice(block).to_batches()
        if rest := sum(b.num_rows for b in held):
            yield from rows(pa.Table.from_batches(held), -(-rest // block))

    return pieces.mapInArrow(gather, f"block long, items array<struct<{item}>>, lengths array<long>")


def pack(pieces: DataFrame, capacity: int = 4096, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
         generations: int = GENERATIONS) -> DataFrame:
    """The rows of `pieces` (with a `length` of 0 to `capacity`) with sequence_id and offset added.

    Full pieces are sequences of their own.  The others are dealt into blocks of at most `block` rows.  Several islands
    work on each block from different seeds; after an epoch each island's elite migrates to the next island of the same
    block, by a join of (block, island), and the block's best plan wins.  A block loses less than one sequence against
    the bound of its lengths in most cases, so larger blocks waste less and cost more time per task.

    Repeated rows are packed each; an empty table gives none; a null length counts as 0; a length beyond `capacity` is
    an error.  Columns named sequence_id, offset, block, island or at in `pieces` are refused by name.
    """
    spark, taken = pieces.sparkSession, sorted({"sequence_id", "offset", "block", "island", "at"} & set(pieces.columns))
    if taken:
        raise ValueError(f"columns that packing makes itself: {', '.join(taken)}")
    clean = pieces.withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))
    clean = clean.where(F.when(F.col("length").between(0, capacity), True).otherwise(
        F.raise_error(F.lit(f"a piece is longer than {capacity} or of negative length"))))
    table = written(clean, "pieces")
    full = table.where(F.col("length") == capacity) \
        .withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    open_ = table.where(F.col("length") < capacity)
    tasks = max(1, -(-open_.count() // (4 * block)))
    blocks = written(cut_blocks(open_.repartition(tasks), block), "blocks")

    state = blocks.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                          F.array().cast("array<array<int>>").alias("arrived"))
    spread = max(cores(spark), -(-tasks * islands // 4))
    for epoch in range(epochs):
        def work(frames: Iterator, epoch=epoch) -> Iterator:
            import pandas as pd

            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    lengths = [int(n) for n in row.lengths]
                    elite = evolve(lengths, capacity, [[int(b) for b in a] for a in row.arrived],
                                   (int(row.block) * islands + int(row.island)) * epochs + epoch, generations)
                    out.append((row.block, row.island, row.lengths, elite, max(elite, default=-1) + 1))
                yield pd.DataFrame(out, columns=["block", "island", "lengths", "elite", "n_bins"])

        state = state.repartition(spread, "block", "island").mapInPandas(
            work, "block long, island int, lengths array<long>, elite array<int>, n_bins int")
        state = written(state, "epoch")
        if epoch + 1 < epochs:
            moved = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
            state = state.join(moved, ["block", "island"]).select(
                "block", "lengths", "island", F.array("elite", "migrant").alias("arrived"))
    best = state.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))

    names = [c for c in table.columns]
    placed = blocks.select("block", "items").join(best, "block").select(
        "block", F.explode(F.transform(F.arrays_zip("items", "elite"), lambda x: x)).alias("row")) \
        .select(*[F.col(f"row.items.`{n}`") for n in names], (F.col("block") * _BINS + F.col("row.elite")).alias("sequence_id"))
    return placed.select(*names, "sequence_id", F.expr(
        "coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY length DESC "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("offset")).unionByName(full.select(
            *names, "sequence_id", "offset"))

"""Exact Jaccard join of word n-gram sets by set relations: skipped blocks of index lists, and derived answers.

    1. Documents with equal sets form a class.  A class's elements have one order for all: by hash, common ones after the
       others and frequent ones last.  Two sets that link share an element near the start of both, so an index list per
       element holds those that have it there.
    2. A list is cut into blocks by set size.  How far into a set an element lies bounds the size of partners that it can
       lead to: an entry goes only to the blocks that its position admits, and skips the others with all they hold.
    3. In each block the class with the most company is the leader.  The others are compared with it, a pair for each class
       and leader, never all pairs of a block: the clearly different ones on their first elements, the rest on full sets.
       Their answer is known from here on as a difference D from the leader's set.
    4. Answers between two classes of one block are derived from the leader's: the difference of x and y is that of Dx and
       Dy.  It can be small enough only if the Ds overlap in their first elements, which is a join on (leader, element).
       The few pairs that pass are confirmed on full sets.
    5. Components are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import written
from .neardup import components, shingles

WORDS = 4
PERCENT = 85
FREQUENT = 1 << 18   # elements that may be put last: two megabytes for each task
COMMON = 1 << 24     # elements that may be put before those and after the others: a sieve of 16 megabytes at most
SAMPLED = 4          # one of so many texts, chosen by hash, tells which are frequent
TOGETHER = 256       # classes compared with a leader in one group


def _places(values, bits: int):
    """The word and the four bits in it that stand for each hash (u8 array) in a sieve of 2^bits words."""
    import numpy as np

    one, six = np.uint64(1), np.uint64(63)
    marks = one << (values & six)
    for shift in (6, 12, 18):
        marks |= one << (values >> np.uint64(shift) & six)
    return (values >> np.uint64(64 - bits)).astype("i8"), marks


def sieve(hashes: DataFrame, count: int):
    """About `count` hashes (one long column) as a blocked Bloom filter (a numpy array of 2^4 to 2^21 words).

    It is made by tasks, a sixteenth of its words by each, so the driver gets its words alone.  More hashes than fit at eight
    bits each let more others through, and never lose one.
    """
    import numpy as np

    bits = min(21, max(4, (max(count, 1) * 8 // 64).bit_length()))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = np.zeros(1 << bits, "u8")
        for batch in batches:
            at, marks = _places(batch.column("hash").to_numpy().view("u8"), bits)
            np.bitwise_or.at(words, at, marks)
        found = [(k, part.tobytes()) for k, part in enumerate(np.split(words, 16)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.binary())],
                                         names=["part", "words"])

    hashes = hashes.select(F.col(hashes.columns[0]).alias("hash")).where("hash IS NOT NULL")
    parts = hashes.repartition(F.shiftrightunsigned("hash", 60)).mapInArrow(work, "part int, words binary").toArrow()
    words = np.zeros(1 << bits, "u8")
    for part, some in zip(parts.column("part").to_pylist(), parts.column("words").to_pylist()):
        words.reshape(16, -1)[part] |= np.frombuffer(some, "u8")
    return words


def passes(values, words):
    """Which hashes (u8 array) a sieve lets through: all that it was made of, and a few others."""
    at, marks = _places(values, len(words).bit_length() - 1)
    return words[at] & marks == marks


def counted_elements(docs: DataFrame, width: int = WORDS, one_in: int = SAMPLED, least: int = 2) -> DataFrame:
    """element, n: elements of at least `least` different sets among a sample of the texts."""
    def work(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [s for s in (shingles(t.as_py(), width) for t in batch.column("text")) if len(s)]
            digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
            for at in range(0, len(sets), 256):
                some = sets[at:at + 256]
                offsets = np.cumsum([0, *map(len, some)]).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[at:at + 256], pa.binary()), pa.ListArray.from_arrays(offsets, np.concatenate(some).view("i8"))], names=["digest", "elements"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text")
    sets = sample.mapInArrow(work, "digest binary, elements array<long>")
    # Copies count once: one set for each digest.
    return written(sets.groupBy("digest").agg(F.first("elements").alias("elements")).select(F.explode("elements").alias("element"))
                   .groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") >= least), "frequent")


def _most_counted(counted: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The `most` elements with the largest counts, or fewer: those above the smallest count that leaves so many.  And how many."""
    # One row for each count that there is, not for each element.
    upto = F.sum("m").over(Window.orderBy(F.desc("n")))
    cut, n = (counted.groupBy("n").agg(F.count("*").alias("m")).select("n", upto.alias("upto")).where(F.col("upto") <= most)
              .agg(F.min("n"), F.max("upto")).first())
    return counted.where(F.col("n") >= cut if cut is not None else F.lit(False)).select("element"), n or 0


def frequent_elements(docs: DataFrame, width: int = WORDS, most: int = FREQUENT, one_in: int = SAMPLED, least: int = 2):
    """Elements of at least `least` different sets among a sample of the texts, not more than the `most` most frequent ones
    (a numpy array): those above the smallest count that leaves so many.
    """
    return _most_counted(counted_elements(docs, width, one_in, least), most)[0].toArrow().column("element").to_numpy()


def late_elements(docs: DataFrame, width: int = WORDS, frequent: int = FREQUENT, common: int = COMMON, one_in: int = SAMPLED):
    """What comes late in the order of elements: the most frequent ones (a numpy array), and a sieve of the common ones, which
    are all that two different sets of the sample share, up to `common` of them.

    Any order gives the same links, as long as all sets have the same; this one keeps passages that many documents share out
    of the index lists.  The frequent ones alone don't: the more texts there are, the more others are in many of them, and
    pairs that share no more than such an element would grow faster than the texts.
    """
    counted = counted_elements(docs, width, one_in)
    last = _most_counted(counted, frequent)[0].toArrow().column("element").to_numpy()
    return last, sieve(*_most_counted(counted, max(frequent, common)))


def _kept(percent: int, size: int) -> int:
    """How many of a set's first elements are kept: those that can be the first one shared with a partner of any size, and
    some more than the first elements of a difference that `derived_pairs` asks for."""
    return min(size, max(size - -(-percent * size // 100) + 1, int(1.25 * _first(percent) * size) + 2))


def _first(percent: int) -> float:
    """Two sets that link have the first element that they both have, but a third lacks, within this share of their sizes."""
    return (100 - percent) / (100 + percent) * (1 + 100 / percent)


def _order(frequent, common=None):
    """A function that tells how late elements (a u8 array) come: 0, or 1 for common ones, or 2 for frequent ones."""
    import numpy as np

    last = np.sort(np.array(frequent if len(frequent) else [0], "i8").view("u8"))

    def is_last(elements):
        return last[np.minimum(np.searchsorted(last, elements), len(last) - 1)] == elements

    def late(elements):
        if common is None:
            return is_last(elements).astype("i1") * 2
        found = passes(elements, common).astype("i1")   # the frequent ones are common too
        some = np.flatnonzero(found)
        found[some] += is_last(elements[some])
        return found

    return late


def _in_order(elements, levels):
    """Elements that are sorted by hash, in the common order."""
    import numpy as np

    return np.concatenate([elements[levels == k] for k in range(3)])


def ordered_sets(docs: DataFrame, frequent, percent: int = PERCENT, width: int = WORDS, common=None) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set (null if empty), starts: the first elements in the common order."""
    def work(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        late = _order(frequent, common)

        def start(found, levels):
            n = _kept(percent, len(found))
            early = found[levels == 0][:n]
            return early if len(early) == n else _in_order(found, levels)[:n]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_py(), width) for t in part.column("text")]
                levels = np.split(late(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
                starts = [start(s, k) if len(s) else s for s, k in zip(sets, levels)]
                offsets = np.cumsum([0, *map(len, starts)]).astype("i4")
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, np.concatenate(starts).view("i8"))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "starts"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        work, "doc_id long, text_hash long, n_shingles long, digest binary, starts array<long>")


def index_blocks(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """element, block, node, small: the blocks that each entry of an index list is in.

    Blocks are by powers of the largest ratio of sizes of sets that link; the smaller set of a pair meets the larger in its
    own block.  An element at place i (from 0) of a set of n elements can be the first shared one only with partners of at
    most (n - i) * (1 + t) / t - n elements.  `small`: the entry may be that of the smaller set.
    """
    t = percent / 100
    places = F.expr(f"CAST(n - (n * {percent} + 99) div 100 + 1 AS INT)")
    entries = classes.select("node", "n", F.posexplode(F.slice("starts", F.lit(1), places)).alias("i", "element"))
    shared = entries.groupBy("element").agg(F.count("*").alias("_n")).where("_n > 1").select("element")

    def level(size: Column) -> Column:
        return F.floor(F.log(size) / math.log(1 / t) + 1e-9)

    size = F.col("n").cast("double")
    placed = entries.join(shared, "element").select(
        "element", "node", "n", ((F.col("n") - F.col("i")) * ((1 + t) / t) - F.col("n") + 1e-6).alias("reach"), level(size).alias("own"),
        F.explode(F.sequence(level(F.greatest(size * t * (1 - 1e-9), F.lit(1.0))), level(size))).alias("block"))
    smallest = F.pow(F.lit(1 / t), F.col("block")) * (1 - 1e-6)
    return placed.where(F.col("reach") >= smallest).select(
        "element", "block", "node", ((F.col("block") == F.col("own")) & (F.col("reach") >= F.col("n"))).alias("small"))


def leader_pairs(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """leader, node: each class with the leaders of the blocks that it is in."""
    members = written(index_blocks(classes, percent), "index")
    # A block without a smaller set, or with one set only, holds no pair.
    useful = members.groupBy("element", "block").agg(F.count("*").alias("company"), F.max("small").alias("any")).where("company > 1 AND any").drop("any")
    members = written(members.join(useful, ["element", "block"]), "members")
    degree = members.groupBy("node").agg(F.least(F.sum("company"), F.lit(1 << 29)).alias("degree"))
    # The same class should lead wherever it can, so ties go by a hash of the node.
    rank = F.when(F.col("small"), 1 << 61).otherwise(0) + F.col("degree") * (1 << 31) + F.pmod(F.xxhash64("node"), F.lit(1 << 31))
    leaders = members.join(degree, "node").groupBy("element", "block").agg(F.max_by("node", rank).alias("leader"))
    return members.join(leaders, ["element", "block"]).where("node <> leader").select("leader", "node").distinct()


ANSWERS = "leader long, node long, size int, different int, first array<long>, marks array<long>, linked boolean"


def _dealt(pairs: DataFrame) -> DataFrame:
    """leader, group, turn, node: the pairs (turn 1) in groups, each with its leader (turn 0).  A leader with many nodes is in
    several groups, once in each."""
    counts = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TOGETHER)).alias("group"))
    return dealt.select("leader", "group", F.lit(1).alias("turn"), "node").union(
        dealt.select("leader", "group", F.lit(0), F.col("leader")).distinct())


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("leader", "group").sortWithinPartitions("leader", "group", "turn", "node")


def far_answers(pairs: DataFrame, classes: DataFrame, frequent, percent: int, common=None) -> DataFrame:
    """Each pair (leader, node) once more: `far` ones answered from the kept first elements alone, the others without.

    A node is far if, as far as the leader's kept elements reach, it has more elements that the leader lacks than a link
    allows, and as many as `derived_pairs` asks for.  Then the two don't link, and D need not be known to its end.
    """
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        late, k, m, base = _order(frequent, common), (100 - percent) / (100 + percent), 0, np.empty(0, "u8")
        for batch in batches:
            leaders, nodes, sizes, firsts = [], [], [], []
            for leader, turn, node, n, starts in zip(*(batch.column(c).to_pylist() for c in ("leader", "turn", "node", "n")), batch.column("starts")):
                x = starts.values.to_numpy().view("u8")
                if turn == 0:
                    m, base = n, x
                    continue
                most, seen = int(_first(percent) * n) + 1, np.ones(len(x), bool)
                if len(base) < m:  # the leader's kept elements end here, in the common order
                    level, end = late(x), late(base[-1:])[0]
                    seen = (level < end) | (level == end) & (x <= base[-1])
                own = x[seen & ~np.isin(x, base)]
                far = len(own) >= most and len(own) > k * (n + m)
                leaders.append(leader)
                nodes.append(node)
                sizes.append(n)
                firsts.append(own[:most].view("i8") if far else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaders, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["leader", "node", "size", "first"])

    # Elements move once to their node and once to the groups that need them.
    both = _by_group(_dealt(pairs).join(classes.select("node", "n", "starts"), "node"))
    return both.select("leader", "turn", "node", "n", "starts").mapInArrow(work, "leader long, node long, size int, first array<long>")


def leader_answers(pairs: DataFrame, texts: DataFrame, frequent, percent: int, width: int, common=None) -> DataFrame:
    """Each pair (leader, node) on full sets: the node's size, the size of D (what only the node has, then what only the
    leader has) with its first elements and a bit set of it, and whether the two link.

    texts: node and text of every class that is asked for, possibly repeated.  A leader with many nodes has its set in
    several groups; texts go straight to the groups that need them.
    """
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        late, base, before = _order(frequent, common), np.empty(0, "u8"), None
        for batch in batches:
            rows = []
            for leader, group, turn, node, text in zip(*(batch.column(c).to_pylist() for c in ("leader", "group", "turn", "node")), batch.column("text")):
                if (leader, group, turn, node) == before:   # a row that is there twice
                    continue
                before = (leader, group, turn, node)
                found = shingles(text.as_py(), width)
                if turn == 0:
                    base = found
                    continue
                own, lacking = np.setdiff1d(found, base, True), np.setdiff1d(base, found, True)
                d = np.concatenate([_in_order(side, late(side)) for side in (own, lacking)])
                bits = np.zeros(256, bool)
                bits[(d >> np.uint64(56)).astype("i8")] = True
                same = len(found) - len(own)
                rows.append((leader, node, len(found), len(d), d[:int(_first(percent) * len(found)) + 1].view("i8"),
                             np.packbits(bits, bitorder="little").view("<i8"), 100 * same >= percent * (same + len(d))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["leader", "node", "size", "different", "first", "marks", "linked"])

    return _by_group(_dealt(pairs).join(texts, "node")).select("leader", "group", "turn", "node", "text").mapInArrow(work, ANSWERS)


def asked_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """node, text of the asked documents (node, doc_id, text_hash).  A sieve keeps nearly all other texts where they lie."""
    words = sieve(asked.select("text_hash"), asked.count())

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column("text_hash").to_numpy().view("u8"), words)))

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(work, "doc_id long, text_hash long, text string").join(asked, ["doc_id", "text_hash"]).select("node", "text")


def shared_elements(told: DataFrame) -> DataFrame:
    """The rows of told (leader, node, first, slices, others), one for each element of `first` that another node of the leader
    has in its own, with its place `i`; nearly all elements are their node's alone.

    Elements move once, in arrays.  Those of a leader with many nodes are dealt by hash into as many slices as it has groups.
    """
    rest = [f for f in told.schema if f.name not in ("first", "slices")]
    names = [f.name for f in rest]
    placed = F.transform("first", lambda e, i: F.struct(i.cast("int").alias("i"), e.alias("element")))
    mine = F.filter("placed", lambda x: F.pmod(F.xxhash64(x["element"]), F.col("slices")) == F.col("slice"))
    dealt = (told.select(*names, "slices", placed.alias("placed"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
             .withColumn("placed", F.when(F.col("slices") == 1, F.col("placed")).otherwise(mine))
             .select(*names, "slice", F.col("placed.i").alias("i"), F.col("placed.element").alias("element")))

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def shared(rows: list) -> Iterator:
            """The rows of a group with what other rows of it have too."""
            if len(rows) < 2:
                return
            elements = np.concatenate([r[-1] for r in rows])
            found, place, counts = np.unique(elements, return_inverse=True, return_counts=True)
            some = np.split(counts[place] > 1, np.cumsum([len(r[-1]) for r in rows])[:-1])
            for row, kept in zip(rows, some):
                if kept.any():
                    yield (*row[:-2], row[-2][kept], row[-1][kept])

        def out(rows: list, schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        group, held, ready, schema = None, [], [], None
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in (*names, "i", "element")])
            narrow = zip(*(batch.column(c).to_pylist() for c in names))
            for row, leader, part, i, element in zip(narrow, batch.column("leader").to_pylist(), batch.column("slice").to_pylist(), batch.column("i"), batch.column("element")):
                if (leader, part) != group:
                    ready += shared(held)
                    group, held = (leader, part), []
                held.append((*row, i.values.to_numpy(), element.values.to_numpy()))
            if ready:
                yield out(ready, schema)
                ready = []
        ready += shared(held)
        if ready:
            yield out(ready, schema)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    kept = (dealt.repartition("leader", "slice").sortWithinPartitions("leader", "slice", "node")
            .mapInArrow(work, f"{types}, i array<int>, element array<long>"))
    return kept.select(*names, F.inline(F.arrays_zip("i", "element")))


def derived_pairs(answers: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """leader, node: pairs of classes of one leader that may link and are not yet joined (node, label), from the leader's
    answers alone.

    x and y link if their sets differ in at most k * (|x| + |y|) elements, k = (1 - t) / (1 + t).  They differ as Dx and Dy
    do.  If the Ds have nothing in common, both link with the leader and are joined.  Else what stands before their first
    common element is in one of them only, which bounds its places.  Where the Ds are known to their ends they must have
    `need` elements in common, which bounds the places, and the bits that both have.
    """
    k = (100 - percent) / (100 + percent)
    label = joined.select(F.col("node").alias("_n"), "label")
    rows = answers.join(label, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("label", "node")).drop("_n")
    rows = rows.join(label.select(F.col("_n").alias("_l"), F.col("label").alias("leading")), F.col("leader") == F.col("_l"), "left").withColumn(
        "apart", F.col("label") != F.coalesce("leading", "leader")).drop("_l", "leading")
    # Only leaders with two classes or more, not all joined with them, can have more to tell.
    telling = rows.groupBy("leader").agg(F.count("*").alias("_n"), F.max("apart").alias("_any")).where("_n > 1 AND _any").select("leader", "_n")
    marked = F.aggregate("marks", F.lit(0), lambda n, m: n + F.bit_count(m))
    told = rows.join(telling, "leader").select("leader", "node", "size", "different", "label", "apart", "marks", (F.col("different") - marked).alias("hidden"),
                                               "first", F.ceil(F.col("_n") / TOGETHER).cast("int").alias("slices"))
    starts = written(shared_elements(told), "telling")
    x, y = starts.alias("x"), starts.alias("y")
    allowed = k * (F.col("x.size") + F.col("y.size")) + 1e-9
    need = (F.col("x.different") + F.col("y.different") - allowed) / 2
    same_marks = F.aggregate(F.zip_with("x.marks", "y.marks", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, m: n + m)
    enough = ((F.least(F.col("x.different") - F.col("x.i"), F.col("y.different") - F.col("y.i")) >= need)
              & (same_marks + F.least("x.hidden", "y.hidden") >= need))
    promising = (
        (F.col("x.leader") == F.col("y.leader")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.label") != F.col("y.label"))
        & F.col("x.apart") & (~F.col("y.apart") | (F.col("x.node") < F.col("y.node")))
        & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size"))
        & (F.col("x.i") + F.col("y.i") <= allowed)
        & (F.col("x.different").isNull() | F.col("y.different").isNull() | enough))
    return x.join(y, promising).select(F.least("x.node", "y.node").alias("leader"), F.greatest("x.node", "y.node").alias("node")).distinct()


def join_sets(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, most_frequent: int = FREQUENT, most_common: int = COMMON) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component_id for each row of docs (doc_id, text).

    Two documents link if 100 * intersection >= percent * union of their sets of `width`-word shingles (A-Z in lower case;
    with fewer words, all of them are one).  class_id is the smallest doc_id with the same set, component_id the smallest
    that links lead to.  No link is missed and every one is confirmed on full sets (of 64-bit hashes).  Documents without
    words link with nothing and have their own id; rows without a doc_id have no ids and link with nothing.  A doc_id that
    is not a number of the table's type is refused by name.  Other columns are not looked at.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent, common = late_elements(docs, width, most_frequent, most_common) if most_frequent else ([], None)
    made = written(ordered_sets(docs, frequent, percent, width, common), "sets")
    grouped = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("starts").alias("starts"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "n", "starts"), "classes")

    pairs = written(leader_pairs(classes, percent), "pairs")

    def answers(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("leader").alias("node")).union(pairs.select("node")).distinct().join(classes.select("node", "rep"), "node")
        texts = asked_texts(docs, written(asked.select("node", "rep.doc_id", "rep.text_hash"), "asked"))
        return written(leader_answers(pairs, texts, frequent, percent, width, common), "answers")

    def linked(found: DataFrame) -> DataFrame:
        return found.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))

    judged = written(far_answers(pairs, classes, frequent, percent, common), "far")
    near = answers(judged.where("first IS NULL").select("leader", "node"))
    far = judged.where("first IS NOT NULL").select(
        "leader", "node", "size", F.lit(None).cast("int").alias("different"), "first", F.lit(None).cast("array<bigint>").alias("marks"), F.lit(False).alias("linked"))
    derived = written(derived_pairs(near.unionByName(far), components(linked(near)), percent), "derived")
    links = written(linked(near).unionByName(linked(answers(derived))), "links")

    label = components(links)
    least = label.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep.doc_id").alias("least"))
    named = classes.join(label.join(least, "label").select("node", "least"), "node", "left").select(
        F.col("digest").alias("_digest"), F.col("rep.doc_id").alias("_class"), F.coalesce("least", "rep.doc_id").alias("_least"))
    with_id = F.col("doc_id").isNotNull()
    return made.join(named, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(with_id, F.coalesce("_class", "doc_id")).alias("class_id"),
        F.when(with_id, F.coalesce("_least", "doc_id")).alias("component_id"))

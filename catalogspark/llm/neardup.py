"""Near-duplicate classes by circulant MinHash, with every link confirmed on full shingle sets.

    1. A task turns each text into its set of hashed shingles, a digest of the set, and band keys.  Two permutations make
       all coordinates: the first spreads the shingles over the universe, the second is used again and again, shifted
       circularly by one more step for each coordinate.
    2. Documents with equal sets form a class; only classes go on.  Classes that share a band key are in one bucket.
    3. The best-connected class of a bucket is its hub.  Each other class of the bucket is compared with the hub on full
       sets: one pair per class and hub, never all pairs of a bucket.  A hub with many classes is split into chunks.
    4. Two classes of one bucket that are not linked through hubs may still be linked with each other.  What differs
       between a class and its hub is a small set D, and the symmetric difference of two classes is that of their Ds.
       So a link needs Ds with a large overlap, and then they share one of their first few elements in a fixed order:
       an equi-join on (hub, element) with bounds on lengths and positions finds all such pairs, and few others.
    5. Components are the connected components of the links, by minimum labels with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..session import written

WORDS = 5
ROWS, BANDS = 5, 30      # at a similarity of 0.85 a pair shares no band with a chance of 6e-8; at 0.8 of 7e-6
CHUNK = 256              # classes compared with a hub in one group

_M64 = (1 << 64) - 1


class _Known(dict):
    """Hashes of words seen by this worker."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word)
        if len(self) > 150_000:
            self.clear()
        self[word] = value
        return value


_WORDS = _Known()


def _spread(x):
    """A fixed permutation of 64-bit numbers (numpy arrays)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WORDS):
    """The sorted set of hashed shingles of a whole text, A-Z in lower case; fewer words make one shingle of all."""
    import numpy as np

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, "u8")
    hashes = np.fromiter(map(_WORDS.__getitem__, words), "u8", len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, "u8")
    for k in range(span):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(words) - span + 1 + k]
    return np.unique(_spread(total))


def band_keys(sets: list, rows: int = ROWS, bands: int = BANDS):
    """Band keys, one row per non-empty set: circulant MinHash of rows * bands coordinates, folded by bands."""
    import numpy as np

    starts = np.cumsum([0, *map(len, sets[:-1])])
    place = (_spread(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("u4")
    work, extra = np.empty_like(place), np.empty_like(place)
    keys = np.empty((len(sets), bands), "u8")
    for band in range(bands):
        key = np.full(len(sets), band + 1, "u8")
        for row in range(rows):
            # The second permutation of the place, shifted by the number of the coordinate.
            np.subtract(place, np.uint32(band * rows + row), out=work)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(work, np.uint32(shift), out=extra)
                np.bitwise_xor(work, extra, out=work)
                np.multiply(work, np.uint32(factor), out=work)
            np.right_shift(work, np.uint32(16), out=extra)
            np.bitwise_xor(work, extra, out=work)
            key = _spread(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, starts))
        keys[:, band] = key
    return keys.view("i8")


SIGNATURES = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"


def signatures(docs: DataFrame, width: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, band keys; a text without words has no digest and no bands."""
    def work(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        def out(ids, hashes, sets):
            full = [s for s in sets if len(s)]
            made = iter(band_keys(full, rows, bands)) if full else iter(())
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(made) if len(s) else np.empty(0, "i8") for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands"])

        for batch in batches:
            held, size = ([], [], []), 0
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(),
                                               batch.column("text")):
                found = shingles(text.as_py(), width)
                for values, value in zip(held, (doc_id, text_hash, found)):
                    values.append(value)
                size += len(found)
                if size > 60_000:  # small enough for the processor's cache
                    yield out(*held)
                    held, size = ([], [], []), 0
            if held[0]:
                yield out(*held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text") \
        .mapInArrow(work, SIGNATURES)


COMPARED = ("hub long, node long, hub_size int, size int, different int, first array<long>, b0 long, b1 long, b2 long, b3 long, "
            "linked boolean")


def _compare(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Each pair (hub, node) on full sets: sizes, how many shingles differ, and those, what only the node has first."""
    counts = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    chunked = pairs.join(counts, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    members = chunked.join(texts, "node").select("hub", "chunk", F.lit(1).alias("part"), "node", "text")
    hubs = chunked.select("hub", "chunk").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select(
        "hub", "chunk", F.lit(0).alias("part"), F.col("hub").alias("node"), "text")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        base = np.empty(0, "u8")
        for batch in batches:
            out = []
            for hub, part, node, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "node")), batch.column("text")):
                found = shingles(text.as_py(), width)
                if part == 0:
                    base = found
                    continue
                added, missing = np.setdiff1d(found, base, True), np.setdiff1d(base, found, True)
                common, differ = len(found) - len(added), len(added) + len(missing)
                # The order of elements is the same for all classes of a hub: by hash, what the hub lacks before the rest.
                first = np.concatenate([added, missing])
                marks = np.zeros(256, bool)
                marks[(first >> np.uint64(56)).astype("i8")] = True
                out.append((hub, node, len(base), len(found), differ, first.view("i8"),
                            *np.packbits(marks, bitorder="little").view("<i8").tolist(),
                            100 * common >= percent * (common + differ)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()),
                         *[pa.int64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[
                    "hub", "node", "hub_size", "size", "different", "first", "b0", "b1", "b2", "b3", "linked"])

    return members.unionByName(hubs).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "part") \
        .select("hub", "part", "node", "text").mapInArrow(work, COMPARED)


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for all nodes of `links` (a, b)."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        moved = labels.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        moved = written(moved, "labels")
        jump = moved.select(F.col("node").alias("_to"), F.col("label").alias("_label"))
        after = written(moved.join(jump, moved.label == jump._to).select(
            "node", F.col("_label").alias("label"), (F.col("_label") != F.col("was")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if not after.where("changed").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets.  component_id is the
    smallest doc_id reachable; kept marks the rows that have it as their own.  Documents without words, and rows without
    a doc_id, are linked with nothing: the first have their own id, the second none, and both are kept.  Rows that repeat
    a doc_id and its text are kept together.
    """
    made = written(signatures(docs, width), "signatures")
    # A class: documents with one set.  Its text is that of its smallest document.
    grouped = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "n", "bands"), "classes")

    dealt = classes.select("node", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(dealt.join(shared, "bucket").select("bucket", "node", "n"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "node").groupBy("bucket").agg(
        F.max(F.struct("degree", -F.col("node"))).alias("top")).select("bucket", (-F.col("top.col2")).alias("hub"))
    pairs = written(members.join(hubs, "bucket").where("node <> hub").select("hub", "node").distinct(), "pairs")

    wanted = pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct().join(
        classes.select("node", "rep"), "node")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = written(own.join(wanted, (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash")))
                    .groupBy("node").agg(F.first("text").alias("text")), "texts")
    compared = written(_compare(pairs, texts, percent, width), "compared")
    direct = compared.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = components(direct)

    links = direct.unionByName(_rest(compared, labels, percent))
    final = components(written(links, "links"))
    smallest = final.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep.doc_id").alias("least"))
    named = classes.join(final.join(smallest, "label").select("node", "least"), "node", "left").select(
        F.col("digest").alias("_digest"), F.coalesce("least", "rep.doc_id").alias("_least"))
    return (made.join(named, F.col("digest") == F.col("_digest"), "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")))
            .select("doc_id", "text_hash", "n_shingles", "component_id",
                    F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")))


def _rest(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between classes of one hub that its own links do not join.

    x and y are similar enough if their sets differ in at most k * (|x| + |y|) elements, k = (100 - percent) /
    (100 + percent), so if their Ds overlap in at least o = (|Dx| + |Dy| - k * (|x| + |y|)) / 2.  Take the first common
    element of both Ds in the common order: no more than what follows it can be common, which bounds its positions.  Each
    D also has a bit for the first eight bits of each element: it has no more elements in common with another than bits,
    plus those of its own that share a bit, which turns away nearly all pairs that can't be links before they are made.
    """
    k = (100 - percent) / (100 + percent)
    label = labels.select(F.col("node").alias("_n"), "label")
    labelled = compared.join(label, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("label", "node")).drop("_n")
    # Only hubs with a class outside the hub's component can have more to find.
    of_hub = label.select(F.col("_n").alias("_h"), F.col("label").alias("hub_label"))
    labelled = labelled.join(of_hub, F.col("hub") == F.col("_h"), "left").withColumn(
        "outside", F.col("label") != F.coalesce("hub_label", "hub")).drop("_h", "hub_label")
    open_hubs = labelled.groupBy("hub").agg(F.count("*").alias("n"), F.max("outside").alias("any")).where("any AND n > 1").select("hub")
    rows = written(labelled.join(open_hubs, "hub"), "open")

    # The longest start of D that can hold the first common element, whatever the other class.
    longest = F.least(F.col("different"), (F.floor(F.lit(k * (1 + 100 / percent)) * F.col("size")) + 1).cast("int"))
    own_bits = sum((F.bit_count(f"b{n}") for n in range(1, 4)), F.bit_count("b0"))
    starts = rows.where("different > 0").select(
        "hub", "node", "size", "different", "label", "outside", "b0", "b1", "b2", "b3",
        (F.col("different") - own_bits).alias("doubled"),
        F.posexplode(F.slice("first", F.lit(1), longest)).alias("pos", "element"))
    x, y = starts.alias("x"), starts.alias("y")
    need = (F.col("x.different") + F.col("y.different") - k * (F.col("x.size") + F.col("y.size"))) / 2 - 1e-9
    same_bits = sum((F.bit_count(F.col(f"x.b{n}").bitwiseAND(F.col(f"y.b{n}"))) for n in range(1, 4)),
                    F.bit_count(F.col("x.b0").bitwiseAND(F.col("y.b0"))))
    close = (
        (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.label") != F.col("y.label"))
        # Each pair once: from the outside class, and between two of them from the smaller id.
        & F.col("x.outside") & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node")))
        & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size"))
        & (F.least(F.col("x.different") - F.col("x.pos"), F.col("y.different") - F.col("y.pos")) >= need)
        & (same_bits + F.least("x.doubled", "y.doubled") >= need))
    found = x.join(y, close).select(F.col("x.hub").alias("hub"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    one = rows.select("hub", F.col("node").alias("a"), F.col("first").alias("fa"), F.col("size").alias("sa"))
    two = rows.select("hub", F.col("node").alias("b"), F.col("first").alias("fb"), F.col("size").alias("sb"))
    both = found.join(one, ["hub", "a"]).join(two, ["hub", "b"])
    differ = F.size("fa") + F.size("fb") - 2 * F.size(F.array_intersect("fa", "fb"))
    common = (F.col("sa") + F.col("sb") - differ) / 2
    return both.where(100 * common >= percent * (common + differ)).select("a", "b")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = WORDS) -> DataFrame:
    """docs with one document of each component, that with the smallest id; rows that repeat its id and text go too.

    Documents without words stay, one for each id; so does every row without an id.
    """
    found = near_duplicates(docs, percent, width)
    keep = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn("__alone", alone).dropDuplicates(["__id", "__hash", "__alone"]).drop("__id", "__hash", "__alone")

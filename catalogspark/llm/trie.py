"""Trie of the prefixes that conversations share, as a z-fast trie: compacted nodes in a hash table by their handles.

    1. Turns are numbered and their prefixes hashed over range-sorted partitions, so that a conversation of any length is
       spread over tasks.  From here on a prefix is a 16-byte key, and texts are out of the way.
    2. The trie holds compacted nodes: an edge of depths (top, depth] that belongs to one conversation's turns.  A node is
       found by its handle: the prefix at the two-fattest depth of its edge, the one divisible by the largest power of two.
    3. In each round all conversations that are not yet in the trie look for their exit node by fat binary search: one
       look-up in the table of handles for each halving of the depth, by joins.  An edge that is left in its middle is
       split there; of those that leave at one place with the same next turn one, chosen by chance, gets a new edge, so
       what is left of such a group falls by about half in a round.
    4. Sums over subtrees are made by pointer doubling over the compacted nodes.
    5. Edges are expanded to one row for each depth.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import written

ROOT = bytes(16)    # the key of the empty prefix
STRIDE = 64         # depths of an edge that are expanded by one join row
CHUNK = 8192        # ids of one row on the way to a digest


def along(df: DataFrame, key: str, order: list[str], xors: tuple = (), sums: tuple = ()) -> DataFrame:
    """Adds `n`, the place of a row (from 1) among those of its long `key`, and running xors and sums of long columns,
    named `<column>_upto`.

    The rows are range-sorted by key and order, so one key may cover many partitions.  A task runs through its range as a
    stream and ends with a row that tells how far the range's last key has come; those rows, one per partition, are added
    up and carried on to the partitions behind.
    """
    names = [f"{c}_upto" for c in (*xors, *sums)]
    added = [T.StructField(c, T.LongType()) for c in ("n", *names)]
    schema = T.StructType([*df.schema.fields, *added, T.StructField("_part", T.IntegerType()), T.StructField("_tail", T.BooleanType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, last, state, tail = TaskContext.get().partitionId(), None, [], None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            of = np.searchsorted(starts, np.arange(size), "right") - 1
            columns = []
            for at, name in enumerate((None, *xors, *sums)):
                value = np.ones(size, "i8") if name is None else batch.column(name).to_numpy().astype("i8")
                fold = np.bitwise_xor if name in xors else np.add
                total = fold.accumulate(value)
                before = np.where(starts > 0, total[starts - 1], 0)[of]
                total = total ^ before if name in xors else total - before
                if keys[0] == last:
                    total[of == 0] = fold(total[of == 0], state[at])
                columns.append(total)
            last, state = keys[-1], [c[-1] for c in columns]
            tail = (batch.slice(size - 1, 1), state)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, columns), pa.array(np.full(size, number, "i4")), pa.array(np.zeros(size, bool))], names=schema.names)
        if tail:
            yield pa.RecordBatch.from_arrays(
                [*tail[0].columns, *[pa.array([int(v)]) for v in tail[1]], pa.array([number], pa.int32()), pa.array([True])], names=schema.names)

    made = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema), "along")
    parts = Window.orderBy("_part")               # one row per partition
    same = Window.partitionBy(key).orderBy("_part")
    fold = {f"{c}_upto": F.bit_xor if c in xors else F.sum for c in (*xors, *sums)}
    carry = made.where("_tail").select(
        F.lead("_part").over(parts).alias("_to"), F.col(key).alias("_key"), F.sum("n").over(same).alias("_n"),
        *[f(c).over(same).alias(f"_{c}") for c, f in fold.items()])
    rows = made.where("NOT _tail").join(carry, (F.col("_part") == F.col("_to")) & (F.col(key) == F.col("_key")), "left")
    upto = {"n": F.col("n") + F.coalesce("_n", F.lit(0))} | {
        c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) if f is F.bit_xor else F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c, f in fold.items()}
    return rows.select(*df.columns, *[v.alias(c) for c, v in upto.items()])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (from 1), digest, bytes for each row that has a conv_id, in the order of turn, null first.

    A null role or text is empty.  Rows that share a turn go by the digest of role and text, so their order is defined;
    rows that repeat are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    return along(turns, "conv_id", ["turn", "digest"]).select("conv_id", "n", "digest", "bytes")


def rebuild(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (turns with conv_id, depth, digest, bytes; conv_ids).

    Conversation c takes the first h turns of conversation c - c % family (all if it has fewer, none if it is not there)
    and its own behind its first h, h = crc32(c as text) % heads.  The remainder has the sign of c.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = written(turns.groupBy("conv_id").agg(F.max("n").alias("len")).withColumn("h", h)
                    .withColumn("base", F.col("conv_id") - F.col("conv_id") % family), "convs")
    head = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("k"))
    taken = turns.where(F.col("n") < heads).withColumnRenamed("conv_id", "base").join(head, "base").where("n <= k").select(
        "conv_id", F.col("n").alias("depth"), "digest", "bytes")
    own = turns.join(head.drop("base"), "conv_id").where("n > h").select(
        "conv_id", (F.col("n") - F.col("h") + F.col("k")).alias("depth"), "digest", "bytes")
    return taken.unionByName(own), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key of the prefix, bytes of the turn, upto: bytes of the prefix."""
    hashed = turns.select("conv_id", "depth", "bytes", F.xxhash64("depth", "digest").alias("x"), F.xxhash64("digest", "depth").alias("y"))
    run = along(hashed, "conv_id", ["depth"], ("x", "y"), ("bytes",))
    key = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("x_upto", "y_upto")]))
    return run.select("conv_id", "depth", key.alias("key"), "bytes", F.col("bytes_upto").alias("upto"))


def fattest(a: str, b: str) -> Column:
    """The two-fattest number in (a, b]: b without the bits below the highest in which a and b differ."""
    return F.expr(f"shiftleft(shiftright({b}, length(bin({a} ^ {b})) - 1), length(bin({a} ^ {b})) - 1)")


def _key_at(rows: DataFrame, paths: DataFrame, conv: str, depth: Column, name: str) -> DataFrame:
    """rows with the key of conversation `conv` at a depth that it has."""
    at = paths.select(F.col("conv").alias("_c"), F.col("depth").alias("_d"), F.col("key").alias(name))
    return rows.join(at, (F.col(conv) == F.col("_c")) & (depth == F.col("_d"))).drop("_c", "_d")


EDGE = ("vkey", "vtop", "vtopkey", "vdepth", "vrep")
STEPS = 5           # halvings of a search that go into one job


def _enter(waiting: DataFrame, paths: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Fat binary search: a, the depth of the deepest node on the path of each conversation (conv, len, end, a, akey), and
    in the columns of EDGE the edge that it enters below, null where there is none.

    Rows whose search is over look up a depth that they have, so that none is without a key and all go one way.
    """
    edges = nodes.select("hkey", "ckey", *[F.col(c[1:]).alias(c) for c in EDGE])
    q = waiting.select("*", F.col("len").alias("b"), *[F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in EDGE])
    columns = q.columns
    candidates = edges.select("hkey", *[F.col(c).alias(f"_{c}") for c in EDGE])
    for step in range(longest.bit_length() if nodes.limit(1).count() else 0):
        # All on the path up to a, nothing beyond b.
        q = q.withColumn("searching", F.col("vkey").isNull() & (F.col("a") < F.col("b")))
        q = q.withColumn("f", F.when(F.col("searching"), fattest("a", "b")).otherwise(F.col("len")))
        q = _key_at(q, paths, "conv", F.col("f"), "fkey").join(candidates, F.col("fkey") == F.col("hkey"), "left")
        q = _key_at(q, paths, "conv", F.least(F.coalesce("_vdepth", "f"), "len"), "ekey")
        hit = F.col("searching") & F.col("_vkey").isNotNull()
        whole = hit & F.coalesce(F.col("ekey") == F.col("_vkey"), F.lit(False))
        q = q.select("conv", "len", "end", F.when(whole, F.col("_vdepth")).otherwise(F.col("a")).alias("a"),
                     F.when(whole, F.col("_vkey")).otherwise(F.col("akey")).alias("akey"),
                     F.when(F.col("searching") & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
                     *[F.when(hit & ~whole, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in EDGE]).select(columns)
        if step % STEPS == STEPS - 1:
            q = written(q, "search")
    # Where the search ends at a node, the edge below it is that of the next turn.
    below = edges.select("ckey", *[F.col(c).alias(f"_{c}") for c in EDGE])
    q = _key_at(q, paths, "conv", F.least(F.col("a") + 1, "len"), "nkey").join(below, F.col("nkey") == F.col("ckey"), "left")
    new = F.col("vkey").isNull() & (F.col("a") < F.col("len"))
    return q.select("conv", "len", "end", "a", "akey", *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in EDGE])


def _leave(entered: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds x and xkey, where a conversation leaves the trie, within its edge or at its node a, and nextkey, the key one
    turn further, null where it ends at x."""
    span = entered.where("vkey IS NOT NULL").select("conv", "vrep", "vtop", F.least("len", "vdepth").alias("m"))
    mine = span.join(paths.select("conv", "depth", "key"), "conv").where("depth > vtop AND depth <= m")
    theirs = paths.select(F.col("conv").alias("vrep"), "depth", "key")
    met = mine.join(theirs, ["vrep", "depth", "key"]).groupBy("conv").agg(F.max("depth").alias("met"))
    left = entered.join(met, "conv", "left").withColumn("x", F.coalesce("met", "a")).drop("met")
    left = _key_at(left, paths, "conv", F.greatest("x", F.lit(1)), "_xkey").withColumn("xkey", F.when(F.col("x") > 0, F.col("_xkey")).otherwise(F.lit(ROOT)))
    left = _key_at(left.drop("_xkey"), paths, "conv", F.least(F.col("x") + 1, "len"), "_nextkey")
    return left.withColumn("nextkey", F.when(F.col("x") < F.col("len"), F.col("_nextkey"))).drop("_nextkey")


def build(classes: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """The compacted nodes below the root: key, depth, top, topkey, rep, hkey (its handle), ckey (its first turn).

    classes: conv, len, end, one row for each different conversation; paths: conv, depth, key of their prefixes.
    """
    nodes = classes.sparkSession.createDataFrame([], "key binary, depth long, top long, topkey binary, rep long, hkey binary, ckey binary")
    waiting = classes.where("len > 0").select("conv", "len", "end", F.lit(0).cast("long").alias("a"), F.lit(ROOT).alias("akey"))
    turn = 0
    while waiting.limit(1).count():
        turn += 1
        exits = written(_leave(written(_enter(waiting, paths, nodes, longest), "entered"), paths), "exits")
        # A conversation that ends at x has nothing left to insert; of the others one for each next turn goes first.
        chosen = exits.where("nextkey IS NOT NULL").groupBy("nextkey").agg(F.min_by("conv", F.xxhash64("conv", F.lit(turn))).alias("chosen"))
        onward = written(exits.join(chosen, "nextkey"), "onward")
        leaves = onward.where("conv = chosen").select(
            F.col("end").alias("key"), F.col("len").alias("depth"), F.col("x").alias("top"), F.col("xkey").alias("topkey"), F.col("conv").alias("rep"))

        cuts = exits.where("vkey IS NOT NULL").dropDuplicates(["xkey"]).select(*EDGE, "x", "xkey")
        cut = cuts.select(*EDGE).dropDuplicates(["vkey"])
        points = cuts.unionByName(cut.select(*EDGE, F.col("vdepth").alias("x"), F.col("vkey").alias("xkey")))
        along_edge = Window.partitionBy("vkey").orderBy("x")
        pieces = points.select(F.col("xkey").alias("key"), F.col("x").alias("depth"), F.coalesce(F.lag("x").over(along_edge), "vtop").alias("top"),
                               F.coalesce(F.lag("xkey").over(along_edge), "vtopkey").alias("topkey"), F.col("vrep").alias("rep"))
        fresh = _key_at(leaves.unionByName(pieces), paths, "rep", fattest("top", "depth"), "hkey")
        fresh = _key_at(fresh, paths, "rep", F.col("top") + 1, "ckey")
        nodes = written(nodes.join(cut.select(F.col("vkey").alias("key")), "key", "left_anti").unionByName(fresh), "nodes")
        waiting = onward.where("conv <> chosen").select("conv", "len", "end", F.col("x").alias("a"), F.col("xkey").alias("akey"))
    return nodes


def _fold_up(state: DataFrame) -> DataFrame:
    """Sums over subtrees: key, n, least, leaves, ends, edges.  state has them for each node alone, and `up`, its parent."""
    kinds = {"n": F.sum, "least": F.min, "leaves": F.sum, "ends": F.sum, "edges": F.sum}
    state = written(state, "fold")
    while state.where("up IS NOT NULL").limit(1).count():
        rising = state.where("up IS NOT NULL")
        gain = rising.groupBy("up").agg(*[f(c).alias(f"_{c}") for c, f in kinds.items()]).withColumnRenamed("up", "_up")
        beyond = rising.where(F.col("up") != F.lit(ROOT)).select(F.col("key").alias("_key"), F.col("up").alias("_to")).join(
            rising.select(F.col("key").alias("_to"), F.col("up").alias("_next")), "_to").select("_key", "_next")
        both = state.drop("up").join(beyond, F.col("key") == F.col("_key"), "left").join(gain, F.col("key") == F.col("_up"), "left")
        state = written(both.select("key", F.col("_next").alias("up"), *[
            (F.least(c, f"_{c}") if c == "least" else F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in kinds]), "fold")
    return state


def _digests(members: DataFrame) -> DataFrame:
    """end, ends_sha256: SHA-256 of the ids (conv_id) of each end, in numeric order with commas between.

    Ids are joined into pieces where they lie sorted; a digest then runs over the pieces of its end as a stream, in one
    task, as it must.
    """
    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows):
            ends, firsts, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["end", "first", "ids"])

        end, ids, rows = None, [], []
        for batch in batches:
            for now, number in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
                if now != end or len(ids) >= CHUNK:
                    if ids:
                        rows.append((end, ids[0], ",".join(map(str, ids))))
                    end, ids = now, []
                    if len(rows) >= 1000:
                        yield out(rows)
                        rows = []
                ids.append(number)
        if ids:
            rows.append((end, ids[0], ",".join(map(str, ids))))
        if rows:
            yield out(rows)

    def digest(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["end", "ends_sha256"])

        end, state = None, None
        for batch in batches:
            rows = []
            for now, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
                if now != end:
                    if state:
                        rows.append((end, state.hexdigest()))
                    end, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if rows:
                yield out(rows)
        if state:
            yield out([(end, state.hexdigest())])

    pieces = members.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").select("end", "conv_id").mapInArrow(
        join, "end binary, first long, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").select("end", "ids").mapInArrow(digest, "end binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each different sequence of first d turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1, without gaps), digest, bytes; convs: conv_id of each conversation, also those without
    turns.  conv_id is the smallest member; saved_tokens adds up, over the subtree, the bytes of a node's last turn for each
    member but the first; ends_sha256 is over the ids that end at the node.  No conversations, no rows.
    """
    every = written(prefixes(turns), "prefixes")
    lengths = every.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = every.select("conv_id", "depth", "key", "upto").join(lengths, ["conv_id", "depth"])
    strings = written(convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("depth", F.lit(0)).alias("len"), F.coalesce("key", F.lit(ROOT)).alias("end"), F.coalesce("upto", F.lit(0)).alias("upto")), "strings")
    classes = written(strings.groupBy("end").agg(F.min("conv_id").alias("conv"), F.count("*").alias("members"), F.max("len").alias("len"), F.max("upto").alias("upto")), "classes")
    paths = written(every.withColumnRenamed("conv_id", "conv").join(classes.select("conv"), "conv", "left_semi"), "paths")
    longest = classes.agg(F.max("len")).first()[0] or 0
    nodes = build(classes, paths, longest)

    # Expanded edges: turn rows find theirs by conversation and stride, of which each has a bounded number of edges.
    strides = nodes.select(F.col("rep").alias("conv"), "key", "top", "topkey", F.col("depth").alias("bottom"), F.explode(F.sequence(
        F.expr(f"(top + 1) div {STRIDE}"), F.expr(f"depth div {STRIDE}"))).alias("stride"))
    turned = paths.select("conv", "depth", "bytes", "upto", F.expr(f"depth div {STRIDE}").alias("stride"))
    expanded = written(turned.join(strides, ["conv", "stride"]).where("depth > top AND depth <= bottom").select(
        "key", "top", "topkey", "bottom", "depth", "bytes", (F.col("upto") - F.col("bytes")).alias("before"), "upto"), "expanded")

    edges = expanded.groupBy("key").agg(F.sum("bytes").alias("edges"))
    children = nodes.groupBy(F.col("topkey").alias("key")).agg(F.count("*").alias("children"))
    whole = nodes.select("key", "topkey").unionByName(classes.sparkSession.createDataFrame([(ROOT, None)], "key binary, topkey binary"))
    alone = (whole.join(classes.select(F.col("end").alias("key"), "members", "conv", "upto"), "key", "left").join(edges, "key", "left")
             .join(children, "key", "left").na.fill(0, ["members", "upto", "edges", "children"]))
    alone = written(alone, "alone")
    total = _fold_up(alone.select(
        "key", F.col("topkey").alias("up"), F.col("members").alias("n"), F.col("conv").alias("least"), (F.col("children") == 0).cast("long").alias("leaves"),
        (F.col("members") * F.col("upto")).alias("ends"), "edges"))
    ends = expanded.where("depth = bottom").select("key", F.col("upto").alias("bottom_upto"))
    known = written(total.drop("up").join(alone.select("key", "children", F.col("edges").alias("own")), "key").join(ends, "key", "left")
                    .join(_digests(strings).withColumnRenamed("end", "key"), "key", "left"), "known")

    nothing = F.sha2(F.lit(""), 256)
    at_bottom = F.col("depth") == F.col("bottom")
    # What the members' texts take from this depth on, less what the nodes take, each once.
    once = F.col("edges") - F.col("own") + F.col("bottom_upto") - F.col("before")
    above = known.select(F.col("key").alias("topkey"), F.col("least").alias("above"))
    below = expanded.join(known, "key").join(above, "topkey").select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top") + 1, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_bottom, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("ends") - F.col("n") * F.col("before") - once).alias("saved_tokens"),
        F.when(at_bottom, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"))
    root = known.where((F.col("key") == F.lit(ROOT)) & (F.col("n") > 0)).select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("ends") - F.col("edges")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return root.unionByName(below)

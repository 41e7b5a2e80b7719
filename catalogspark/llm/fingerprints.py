"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs, in DataFrame functions only.

A paragraph here is what stands between line ends and sentence marks; where that is longer than 300 characters, it is cut
by its content, so that an edit touches only what is near it.  It is hashed to 64 bits.  A sketch has three tables of cells; each digest is added to one cell of each table: a count, the digests' exclusive or, and that of their checks.
Sketches of two versions subtract cell by cell, so what both have is gone.  A cell with one digest left shows it by its
check; taking it out of its other cells uncovers more.  If that ends before all cells are empty, larger sketches are
tried: the digests are dealt into eight by their first bits, again and again until a share is small, and each share has
a sketch of its own, made larger where it fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

# A sentence; in longer runs up to the next mark within, word that ends in d or y, or rare letter; at the worst 300 characters.
PASSAGE = r"[^.!?\n]{1,300}+(?![^.!?\n])|[^.!?\n]{0,298}?(?:[,;:\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f7Xx]|[dy] )|[^.!?\n]{1,300}"
TABLES = 3
CELLS = 4              # per table of the fingerprint itself
SHARE = 4              # digests of both versions that one of the larger sketches has at most, if they differ in their bits
LADDER = (3, 10, 40)   # cells per table of a share's sketch, one try after the other
BITS = 3               # of a digest that one dealing goes by
LEVELS = 5             # dealings


def paragraph_digests(text: Column, passage: str = PASSAGE) -> Column:
    """The distinct digests of the passages, without spaces around them; those of spaces only and a null text have none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(passage), F.lit(0))
    bare = F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(bare, lambda p: F.xxhash64(p)))


def _place(digest: Column, table: int, cells: int) -> Column:
    return (F.pmod(F.shiftrightunsigned(digest, 16 * table), F.lit(cells)) + table * cells).cast("int")


def sketch(digests: Column, cells: int = CELLS) -> Column:
    """Cells (count, digests, checks) of an array of distinct digests."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def table(t):
        return F.transform(F.sequence(F.lit(t * cells), F.lit((t + 1) * cells - 1)), lambda j: F.aggregate(
            F.filter(digests, lambda d: _place(d, t, cells) == j), zero,
            lambda a, d: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(d).alias("k"),
                                  a["h"].bitwiseXOR(F.xxhash64(d)).alias("h"))))

    return F.concat(*[table(t) for t in range(TABLES)])


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: F.struct(
        (a["c"] - b["c"]).alias("c"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h")))


def peel(difference: Column, cells: int, steps: Column) -> Column:
    """The digests that two versions differ in, from their subtracted sketch, or null if it can't be peeled.

    Each step takes out one digest, so as many steps are needed as digests can differ.
    """
    def pure(x):
        return (F.abs(x["c"]) == 1) & (x["h"] == F.xxhash64(x["k"]))

    def without(state, p):
        def cell(x, j):
            hit = (j == _place(p["k"], 0, cells)) | (j == _place(p["k"], 1, cells)) | (j == _place(p["k"], 2, cells))
            return F.when(hit, F.struct((x["c"] - p["c"]).alias("c"), x["k"].bitwiseXOR(p["k"]).alias("k"),
                                        x["h"].bitwiseXOR(p["h"]).alias("h"))).otherwise(x)

        return F.struct(F.transform(state["cells"], cell).alias("cells"), F.concat(state["found"], F.array(p["k"])).alias("found"))

    def step(state, _):
        # A one-element array binds the cell that is taken out, so that it is looked for once.
        first = F.slice(F.filter(state["cells"], pure), 1, 1)
        return F.coalesce(F.get(F.transform(first, lambda p: without(state, p)), F.lit(0)), state)

    zero = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"))
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, zero, step, lambda s: F.when(
        F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)), s["found"]))


def _deal(shares: Column, level: int) -> Column:
    """Splits shares that are too large into eight by three more bits of the digest."""
    last = (1 << BITS) - 1

    def split(g):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")), lambda b: F.filter(
            g, lambda x: F.shiftrightunsigned(x["d"], 64 - BITS * (level + 1)).bitwiseAND(F.lit(last).cast("long")) == b))

    return F.flatten(F.transform(shares, lambda g: F.when(F.size(g) <= SHARE, F.array(g)).otherwise(split(g))))


def larger(one: Column, other: Column) -> Column:
    """Differing digests by the larger sketches.  A share that no sketch resolves (a chance of some millionths) is compared
    digest by digest, so there always is a result."""
    def tag(digests, side):
        return F.transform(digests, lambda d: F.struct(d.alias("d"), F.lit(side).alias("s")))

    shares = F.array(F.concat(tag(one, 1), tag(other, -1)))
    for level in range(LEVELS):
        shares = _deal(shares, level)

    def resolve(g):
        a = F.transform(F.filter(g, lambda x: x["s"] == 1), lambda x: x["d"])
        b = F.transform(F.filter(g, lambda x: x["s"] == -1), lambda x: x["d"])
        tries = [peel(subtract(sketch(a, cells), sketch(b, cells)), cells, F.size(g)) for cells in LADDER]
        return F.coalesce(*tries, F.concat(F.array_except(a, b), F.array_except(b, a)))

    return F.flatten(F.transform(F.filter(shares, lambda g: F.size(g) > 0), resolve))


def differing(one: str, other: str, one_cells: str, other_cells: str) -> Column:
    """The digests in which two columns of digests differ, first by their fingerprints' cells, then by larger sketches."""
    most = TABLES * CELLS  # a sketch can't show more digests than it has cells
    own = peel(subtract(F.col(one_cells), F.col(other_cells)), CELLS, F.least(F.size(one) + F.size(other), F.lit(most)))
    return F.coalesce(own, larger(F.col(one), F.col(other)))


def likeness(one: str, other: str, difference: str) -> Column:
    """Shared digests over all digests, from the sizes and the number that differ; 1 if neither has any."""
    total = F.size(one) + F.size(other)
    return F.when(total == 0, 1.0).otherwise((total - F.size(difference)) / (total + F.size(difference)))


def fingerprint_text(digests: str, cells: str) -> Column:
    """A fingerprint as text: the number of digests, then count:digests:checks of each cell."""
    one = F.transform(cells, lambda x: F.concat_ws(":", x["c"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"]))))
    return F.concat_ws(" ", F.size(digests).cast("string"), F.array_join(one, " "))


def neighbours(docs: DataFrame) -> DataFrame:
    """One row per doc_id that is not null: doc_id, prior_id (after the last comes the first), half (half the characters
    of the prior document), text_hash (of the row that stands for the id, if it has several).

    Ids are range-sorted; a row looks for its neighbour in its own range, and only the ends of the ranges, one row per
    partition, are put in order together.
    """
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2)).cast("int").alias("half"), F.min(F.xxhash64(F.coalesce("text", F.lit("")))).alias("text_hash"))
    ranged = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    ends = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "half")).alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.select(F.col("part").alias("_part"), F.coalesce(
        F.lag("last").over(by_part), F.last("last").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    within = ranged.withColumn("before", F.lag(F.struct("doc_id", "half")).over(Window.partitionBy("part").orderBy("doc_id")))
    prior = F.coalesce("before", "end")
    return within.join(ends, F.col("part") == F.col("_part")).select(
        "doc_id", prior["doc_id"].alias("prior_id"), prior["half"].alias("half"), "text_hash")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each text beside an edited version and beside the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edited (how many digests
    differ from the edited text), edited_digests (which).  The edited text has the second half of its code points replaced
    by the first as many of the document with the next larger doc_id.  Each text is shuffled once, by id; the head of a
    document and its digests travel to the document before it.

    A null text is the empty text.  Rows that repeat an id are each compared with the next id's row (that with the
    smallest hash); rows without an id have no next document: nothing replaces their second half.  An id that is alone is
    its own next.  Equal texts have equal fingerprints.
    """
    links = written(neighbours(docs), "neighbours")
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # What is sent and what receives it start from the same shuffle of the texts by id.
    rows = every.where("doc_id IS NOT NULL")
    head = F.struct(F.substring("text", F.lit(1), F.col("half")).alias("head"), paragraph_digests(F.col("text")).alias("digests"))
    # Written as a difference, the hash is no second join key, which would need a shuffle of its own.
    stands = F.xxhash64("text").bitwiseXOR(F.col("text_hash")) == 0
    sent = (rows.join(links, "doc_id").where(stands)
            .select(F.col("prior_id").alias("to"), head.alias("next")).groupBy("to").agg(F.first("next").alias("next")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.length("text") - half).cast("int")),
                      F.substring(F.coalesce("next.head", F.lit("")), F.lit(1), half))
    none = F.array().cast("array<bigint>")
    received = rows.join(sent, F.col("doc_id") == F.col("to"), "left").select("doc_id", "text", "next")
    alone = every.where("doc_id IS NULL").withColumn("next", F.lit(None).cast(received.schema["next"].dataType))
    both = received.unionByName(alone).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"),
        F.coalesce("next.digests", none).alias("n"))
    digests = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                          paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("edited")).alias("e"), "n")
    cells = digests.select("*", sketch(F.col("a")).alias("ac"), sketch(F.col("e")).alias("ec"), sketch(F.col("n")).alias("nc"))
    found = cells.select("*", differing("a", "e", "ac", "ec").alias("de"), differing("a", "n", "ac", "nc").alias("dn"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint_text("a", "ac").alias("fingerprint"),
                        fingerprint_text("e", "ec").alias("edited_fingerprint"), likeness("a", "e", "de").alias("near_edited"),
                        likeness("a", "n", "dn").alias("near_next"), F.size("de").cast("long").alias("n_edited"),
                        F.col("de").alias("edited_digests"))

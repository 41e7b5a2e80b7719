"""Source divergence audit: how far the word use of each source lies from the others, by hash-consed segment trees.

    1. Tasks count terms; sums per (lang, source, term) and per (lang, term) follow.  A language keeps the terms that
       enough of its documents have, and numbers them by falling count, so that rare ones stand together.
    2. A group's counts over the numbered terms are the leaves of its segment tree.  The tree is cut into subtrees of
       BLOCK leaves.  A task gets the counts of all groups of a language in one block and builds their subtrees from the
       leaves up, where equal (left, right) children are one node: equal count subtrees are shared by all groups.
    3. Pairs of groups are walked from the roots down, all at once, level by level.  Pairs of nodes that are met again are
       one pair with a larger multiplicity, so each is priced once, at the leaves, where it is a pair of counts.
    4. The sums of the blocks are added up by (lang, source, other).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import running_total

BLOCK = 2048        # leaves of the subtree that a task holds
HELD = 500_000      # (lang, source, term) that a task counts before it hands them on
SLICE = 128         # groups of a block whose pairs with all others one task walks
SCALE = 1_000_000_000
DOCUMENTS = 3
RANKS = 200

# Bytes of a term: ASCII letters, in lower case, and everything beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), and one row with a null term for each group.

    A null text, lang or source is ''.  Every row of `docs` is a document.  A task adds up before anything is shuffled.
    """
    def work(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        def out(groups):
            rows = []
            for (lang, source), (number, having) in groups.items():
                rows.append((lang, source, None, 0, 0))
                rows += [(lang, source, term.decode("utf-8", "replace"), n, having[term]) for term, n in number.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 50_000]), kinds)],
                                                 names=["lang", "source", "term", "n", "docs"])

        groups, held = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                number, having = groups.setdefault((lang, source), (Counter(), Counter()))
                words = text.as_py().encode().translate(_TERM_BYTES).split()
                held -= len(number)
                number.update(words)
                having.update(set(words))
                held += len(number)
                if held > HELD:
                    yield from out(groups)
                    groups, held = {}, 0
        yield from out(groups)

    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return filled.mapInArrow(work, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) for 0 < count <= total, exact: three decimal digits at a time."""
    quotient, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        more = rest * 1000
        quotient, rest = quotient * 1000 + F.call_function("div", more, total), more % total
    return quotient + 1


def _price(p: Column, q: Column) -> Column:
    square = (p - q) * (p - q)
    return F.call_function("div", square, q)


class Audit:
    """The counted groups of a table of documents, written once; `pairs` and `terms` read them."""

    def __init__(self, docs: DataFrame, least: int = DOCUMENTS):
        counted = written(count_terms(docs), "terms")
        of_lang = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        kept = of_lang.where(F.col("docs") >= least).select("lang", "term", "total", F.lit(1).cast("long").alias("one"), (-F.col("total")).alias("fall"))
        ranked = written(running_total(kept, ["lang", "fall", "term"], "one", "rank").select("lang", "term", "total", "rank"), "ranked")
        langs = ranked.groupBy("lang").agg(F.min("rank").alias("first"), F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        numbered = ranked.join(langs.select("lang", "first"), "lang").select("lang", "term", "total", (F.col("rank") - F.col("first")).alias("id"))
        #: lang, source, term, n, total (of the language), id: kept terms that the group has
        self.rows = written(counted.where("term IS NOT NULL").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "rows")
        #: lang, source, size (N + V of the group), lang_size, v, g (number of the group in its language), groups
        own = self.rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = (counted.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left")
                  .join(langs.select("lang", "v", "lang_n"), "lang", "left").na.fill(0, ["n", "v", "lang_n"]))
        by_source = Window.partitionBy("lang")  # one row per group of the language
        self.groups = written(groups.select(
            "lang", "source", (F.col("n") + F.col("v")).alias("size"), (F.col("lang_n") + F.col("v")).alias("lang_size"), "v",
            (F.row_number().over(by_source.orderBy("source")) - 1).cast("long").alias("g"), F.count("*").over(by_source).cast("int").alias("groups")), "groups")

    def pairs(self, block: int = BLOCK, part: int = SLICE) -> DataFrame:
        """lang, source, other, value: the sum of f over all kept terms, 0 without any, for each two sources of a language."""
        # Every group of the language stands in every block, with or without counts there.
        heads = self.groups.where("groups > 1 AND v > 0").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(v - 1) div {block}"))))
        blank = heads.select("lang", "block", "g", "groups", "size", F.least(F.lit(block), F.col("v") - F.col("block") * block).cast("int").alias("width"),
                             F.lit(-1).alias("leaf"), F.lit(0).cast("long").alias("n"))
        named = self.rows.join(self.groups.where("groups > 1").select("lang", "source", "g", "groups"), ["lang", "source"])
        counts = named.select("lang", F.expr(f"id div {block}").alias("block"), "g", "groups", F.lit(0).cast("long").alias("size"),
                              F.lit(0).alias("width"), F.pmod("id", F.lit(block)).cast("int").alias("leaf"), "n")
        dealt = blank.unionByName(counts).withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(groups - 1) div {part}"))))

        def walk(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            def out(key, held):
                a, b, value = walk_block(*np.concatenate(held, axis=1), key[2] * part, (key[2] + 1) * part)
                return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), *map(pa.array, (a, b, value))],
                                                  names=["lang", "a", "b", "value"])

            key, held = None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                langs = batch.column("lang").dictionary_encode()
                marks = np.stack([langs.indices.to_numpy(), batch.column("block").to_numpy(), batch.column("part").to_numpy()])
                numbers = np.stack([batch.column(c).to_numpy().astype("i8") for c in ("g", "size", "width", "leaf", "n")])
                cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                for start, stop in zip(cuts, cuts[1:]):
                    now = (langs.dictionary[int(marks[0, start])].as_py(), int(marks[1, start]), int(marks[2, start]))
                    if now != key:
                        if held:
                            yield out(key, held)
                        key, held = now, []
                    held.append(numbers[:, start:stop])
            if held:
                yield out(key, held)

        keys = ["lang", "block", "part"]
        walked = (dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "g", "size", "width", "leaf", "n")
                  .mapInArrow(walk, "lang string, a long, b long, value long"))
        sums = walked.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        one = self.groups.select("lang", F.col("g").alias("a"), "source")
        two = self.groups.select("lang", F.col("g").alias("b"), F.col("source").alias("other"))
        # All ordered pairs of sources of a language are the result, also where no term is kept.
        return (one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
                .select("lang", "source", "other", F.coalesce("value", F.lit(0)).alias("value")))

    def terms(self) -> DataFrame:
        """lang, source, term, value: kept terms of a group that it uses more than its language."""
        sized = self.rows.join(self.groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
        priced = sized.select("lang", "source", "term", _share(F.col("n") + 1, F.col("size")).alias("p"), _share(F.col("total") + 1, F.col("lang_size")).alias("q"))
        return priced.where("p > q").select("lang", "source", "term", _price(F.col("p"), F.col("q")).alias("value"))


def _shares(count, size):
    """The same as `_share`, for numpy arrays."""
    import numpy as np

    quotient, rest = np.zeros(len(count), "i8"), count.copy()
    for _ in range(3):
        more, rest = divmod(rest * 1000, size)
        quotient = quotient * 1000 + more
    return quotient + 1


def build_trees(counts):
    """Hash-consed segment trees over the rows of a matrix of counts, whose width is a power of two.

    Returns the roots, the levels from the root down, each with the left and right child of every node, and the count of
    every leaf node.  Node numbers are per level; rows with equal subtrees have equal numbers, wherever they stand.
    """
    import numpy as np

    values, nodes = np.unique(counts, return_inverse=True)
    nodes, levels = nodes.reshape(counts.shape), []
    while nodes.shape[1] > 1:
        width = int(nodes.max()) + 1
        joined, inverse = np.unique(nodes[:, 0::2] * width + nodes[:, 1::2], return_inverse=True)
        levels.append(np.divmod(joined, width))
        nodes = inverse.reshape(len(counts), -1)
    return nodes[:, 0], levels[::-1], values


def walk_block(g, size, width, leaf, n, start: int, stop: int):
    """a, b, value for all pairs of groups with a in [start, stop): f summed over the leaves of a block.

    Each group has one row with its size, the block's width and leaf -1, and a row with a leaf for each of its counts.
    """
    import numpy as np

    heads = np.flatnonzero(leaf < 0)
    heads = heads[np.argsort(g[heads])]
    names, sizes, width = g[heads], size[heads], int(width[heads[0]])
    # Leaves behind the last term have no count and no price.
    counts = np.zeros((len(heads), 1 << (width - 1).bit_length()), "i8")
    counts[:, width:] = -1
    rows = leaf >= 0
    counts[np.searchsorted(names, g[rows]), leaf[rows]] = n[rows]
    roots, levels, values = build_trees(counts)
    done = []
    for k in range(len(heads)):
        if not start <= names[k] < stop:
            continue
        # All other groups against this one.  Equal (group, node, node) are one row with a multiplicity.
        other = np.flatnonzero(np.arange(len(heads)) != k)
        mine, theirs, times = np.full(len(other), roots[k]), roots[other], np.ones(len(other), "i8")
        for left, right in levels:
            both = len(left)
            code = (other * both + mine) * both + theirs
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            times = np.bincount(inverse, times).astype("i8")
            other, mine, theirs = other[first], mine[first], theirs[first]
            other, times = np.concatenate([other, other]), np.concatenate([times, times])
            mine, theirs = np.concatenate([left[mine], right[mine]]), np.concatenate([left[theirs], right[theirs]])
        code = (other * len(values) + mine) * len(values) + theirs
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        times = np.bincount(inverse, times).astype("i8")
        other, x, y = other[first], values[mine[first]], values[theirs[first]]
        real = x >= 0
        other, times, x, y = other[real], times[real], x[real], y[real]
        p, q = _shares(x + 1, np.full(len(x), sizes[k])), _shares(y + 1, sizes[other])
        value = np.zeros(len(heads), "i8")
        np.add.at(value, other, times * ((p - q) ** 2 // q))
        kept = np.arange(len(heads)) != k
        done.append((np.full(kept.sum(), names[k]), names[kept], value[kept]))
    if not done:
        return (np.empty(0, "i8"),) * 3
    return tuple(np.concatenate(c) for c in zip(*done))


def audit(docs: DataFrame, least: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank for the documents' (lang, source) groups.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case.  A language keeps the V terms that at
    least `least` of its rows have.  A group with N occurrences of them gives one that it has c times the share p = 1 +
    floor(SCALE * (c + 1) / (N + V)); so does the language with its own counts.  A share p costs f = floor((p - q)^2 / q)
    against q.  Part `pair`: item is each other source of the language, value f against it, summed over all kept terms.
    Part `term`: item is a kept term of the group with p above the language's q, value f, the first `ranks` ones.

    Null text, lang and source are ''; rows that repeat are counted each time; a language with one source has no pairs; a
    table without rows gives none.  Ties go by the item's bytes.  Other columns, whatever their names, are not looked at.
    Exact as long as a language has fewer than 9 * 10^15 occurrences.
    """
    found = Audit(docs, least)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = found.pairs().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    term = found.terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    # Spark cuts each partition to the first ranks before the shuffle, so no group is gathered whole.
    term = term.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)
    return pair.withColumn("rank", F.row_number().over(by_value)).unionByName(term)

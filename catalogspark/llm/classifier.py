"""Quality classifier: ordinal cumulative-link regression on hashed text, with graded ratings.

A document has grade 0 (toxic), 1 (poor) or 2 (good).  One weight per hashed feature gives a score s; ordered thresholds
t0 < t1 turn it into P(grade <= k) = sigmoid(t_k - s).  So a weight that speaks for a better grade does so at every step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written

SAMPLE = 20_000       # at most so many labelled documents are fitted on, chosen by a hash of their ids
BITS = 20             # 2 ** BITS weights
MIN_DOCS = 5          # features of fewer labelled documents have no weight
MIN_LEAN = 4.0        # nor those whose documents' grades are within so many standard deviations of the usual
EPOCHS = 6
RATE = 0.1
RIDGE = 1e-4
GRADES = 3
TAIL = 0.5            # a document is selected if it is good with at least this probability

_SYMBOL = re.compile(r"[#*$%&|<>^~=+\\@_{}\[\]]")
_EDGES = re.compile(r"^\W+|\W+$")


class _Features(dict):
    """Of each word seen by this worker: (number of the hashed word, numbers of its shapes)."""

    def __missing__(self, word: str):
        from zlib import crc32

        bare = _EDGES.sub("", word.lower())
        shapes = (bool(_SYMBOL.search(word)), len(word) > 1 and word.isupper(), word.endswith(("!!", "??", "..")),
                  any(c.isdigit() for c in word), len(word) > 20, "://" in word or "@" in word, not bare)
        value = (crc32(b"w" + bare.encode()) & ((1 << BITS) - 1) if bare else -1, tuple(k for k, on in enumerate(shapes) if on))
        if len(self) > 150_000:
            self.clear()
        if len(word) <= 48:
            self[word] = value
        return value


_SEEN = _Features()


def features(text: str | None) -> list[int]:
    """Sorted feature numbers of a whole text: its words without marks around them, and how common each shape of word,
    repeated words and repeated lines are, in powers of two."""
    from collections import Counter
    from zlib import crc32

    text = text or ""
    words = Counter(text.split())
    total = sum(words.values())
    found, shapes = set(), Counter()
    for word, times in words.items():
        number, kinds = _SEEN[word]
        if number >= 0:
            found.add(number)
        for kind in kinds:
            shapes[kind] += times

    def level(name, part, whole):
        step = 0 if part == 0 else 12 - min(11, max(0, (whole // max(part, 1)).bit_length() - 1))
        found.add(crc32(f"s{name}:{step}".encode()) & ((1 << BITS) - 1))

    for kind in range(7):
        level(kind, shapes[kind], total)
    lines = [line for line in text.split("\n") if line.strip()]
    level("lines", len(lines) - len(set(lines)), len(lines))
    level("fresh", len(words), total)
    level("short", 1, total + 1)
    return sorted(found)


FEATURES = "grade int, tie long, features array<int>"


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: of several labels of a document the worst counts; rows with a null are left out."""
    whole = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    grade = F.when(F.max("toxic") > 0, 0).when(F.min("quality") <= 0, 1).otherwise(2)
    return whole.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(grade.cast("int").alias("grade"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Features of at most `sample` labelled documents.  Labels of documents that are not there don't count towards the
    bound.  The sample is bounded, so it is broadcast and no text moves."""
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = grades(labels).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("tie"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["grade", "tie", "features"])

    return rows.select("grade", F.xxhash64("doc_id", "text").alias("tie"), "text").mapInArrow(work, FEATURES)


def _sigmoid(x: float) -> float:
    from math import exp

    return 1 / (1 + exp(-x)) if x >= 0 else 1 - 1 / (1 + exp(x))


def fit_rows(rows: list[tuple[int, object]], seed: int = 7):
    """(feature numbers, weights, thresholds) by stochastic gradient ascent of the likelihood with adaptive steps.

    Without rows, or with one grade only, there is nothing to learn: no weights, and every document is good.
    """
    import numpy as np

    if len({grade for grade, _ in rows}) < 2:
        return np.empty(0, "i4"), np.empty(0, "f8"), [-20.0 + k for k in range(GRADES - 1)]
    flat = np.concatenate([f for _, f in rows])
    of = np.repeat(np.array([g for g, _ in rows], "i1"), [len(f) for _, f in rows])
    docs = np.bincount(flat, minlength=1 << BITS)
    useful = np.zeros(1 << BITS, bool)
    for k in range(GRADES - 1):  # most words say nothing; with weights of their own they would only learn documents by heart
        usual = sum(g <= k for g, _ in rows) / len(rows)
        low = np.bincount(flat[of <= k], minlength=1 << BITS)
        useful |= np.abs(low - docs * usual) > MIN_LEAN * np.sqrt(np.maximum(docs * usual * (1 - usual), 1e-9))
    useful &= docs >= min(MIN_DOCS, len(rows))
    rows = [(grade, f[useful[f]]) for grade, f in rows]
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    below = np.cumsum([sum(g == k for g, _ in rows) + 1 for k in range(GRADES)])[:-1] / (len(rows) + GRADES)
    cuts, cut_squares = np.log(below / (1 - below)), np.full(GRADES - 1, 1.0)
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for at in random.permutation(len(rows)):
            grade, f = rows[at]
            score = weights[f].sum()
            upper = 1.0 if grade == GRADES - 1 else _sigmoid(cuts[grade] - score)
            lower = 0.0 if grade == 0 else _sigmoid(cuts[grade - 1] - score)
            slope = 1 - upper - lower          # minus the derivative of the log-likelihood by the score, turned
            step = -slope - RIDGE * weights[f]
            squares[f] += step * step
            weights[f] += RATE * step / np.sqrt(squares[f])
            p = max(upper - lower, 1e-9)
            for k, change in ((grade, upper * (1 - upper) / p), (grade - 1, -lower * (1 - lower) / p)):
                if 0 <= k < GRADES - 1:
                    cut_squares[k] += change * change
                    cuts[k] += RATE * change / cut_squares[k] ** 0.5
            cuts = np.maximum.accumulate(cuts + np.arange(GRADES - 1) * 1e-6)
    used = np.flatnonzero(weights)
    return used.astype("i4"), weights[used], [float(c) for c in cuts]


MODEL = "features binary, weights binary, cuts array<double>"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes, list[float]]:
    """The model: feature numbers, weights, thresholds.  The bounded sample is fitted in one task, in an order that does
    not depend on how rows arrive; the model has at most 2 ** BITS weights, whatever the corpus."""
    rows = written(training_rows(docs, labels, sample), "training")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            for grade, tie, found in zip(batch.column("grade").to_pylist(), batch.column("tie").to_pylist(), batch.column("features")):
                held.append((tie, grade, found.values.to_numpy(zero_copy_only=False)))
        held.sort(key=lambda row: row[:2])
        used, weights, cuts = fit_rows([(grade, found) for _, grade, found in held])
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()]), pa.array([weights.astype("f4").tobytes()]),
                                          pa.array([cuts], pa.list_(pa.float64()))], names=["features", "weights", "cuts"])

    row = rows.coalesce(1).mapInArrow(work, MODEL).first()
    return bytes(row["features"]), bytes(row["weights"]), list(row["cuts"])


SCORES = "score double, expected_grade double, tail_probability double"


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, tail: float = TAIL, keep_text: bool = False,
             prefix: str = "") -> DataFrame:
    """docs with score, expected_grade, tail_probability (that of the best grade) and kept added; every document is scored.

    The text is left out unless `keep_text`.  A null text is scored as the empty text; repeated rows are scored each.
    Columns of docs named as the new ones are replaced; `prefix` gives the new ones other names.
    """
    used, weights, cuts = fit(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((used, weights, cuts))
    made = [prefix + name for name in ("score", "expected_grade", "tail_probability")]
    kept = [c for c in docs.columns if c not in (*made, prefix + "kept") and (keep_text or c != "text")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.DoubleType()) for name in made])

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        used, weights, cuts = model.value
        table = np.zeros(1 << BITS, "f8")
        table[np.frombuffer(used, "i4")] = np.frombuffer(weights, "f4")
        cuts = np.array(cuts)
        for batch in batches:
            scores = np.array([table[features(t.as_py())].sum() for t in batch.column("text")])
            above = 1 / (1 + np.exp(np.clip(cuts[None, :] - scores[:, None], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores), pa.array(above.sum(1)), pa.array(above[:, -1])],
                names=[*kept, *made])

    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])])
    return rows.mapInArrow(work, schema).withColumn(prefix + "kept", F.col(made[2]) >= tail)

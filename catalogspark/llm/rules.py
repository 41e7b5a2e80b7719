"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import SPACES

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BREAKS = r"[\x20\x09-\x0D]+"

# Candidate cutoffs of each measure; a document fails a rule if its measure is above the cutoff chosen.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "upper_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "mark_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "duplicate_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2),
    "mean_word_chars": (9.0, 10.0, 12.0, 15.0, 20.0),
}
FALSE_REJECTION = 0.05    # of good documents in a stratum, all rules together
CONFIDENCE = 0.95         # that no rule in any stratum passes its share of that

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the measures.

    n_repeat_words: words that lie in a window of five words found at least twice in the text.  All of it is worked out
    inside the row: windows are hashed to numbers; only where numbers repeat are they sorted, with their places, so that
    equal ones are neighbours, and the places are swept once.  A null text has no words.  Columns of docs named as the
    new ones are replaced.
    """
    made = (*COUNTS, *CUTOFFS, "n_lines")
    kept = [c for c in docs.columns if c not in made and c != text and not c.startswith("_m_")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("_m_text"))
    bare = F.btrim("_m_text", F.lit(SPACES))
    letters = F.translate("_m_text", SPACES, "")
    lines = F.filter(F.split("_m_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BREAKS)).alias("_m_words"),
        F.length(letters).cast("long").alias("word_chars"),
        (F.length("_m_text") - F.length(F.translate("_m_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_m_text") - F.length(F.translate("_m_text", "!?", ""))).cast("long").alias("_m_marks"),
        F.regexp_count("_m_text", F.lit(r"\p{Lu}")).cast("long").alias("_m_upper"),
        lines.alias("_m_lines"))

    def window(i):
        return F.xxhash64(*[F.get("_m_words", i + k) for k in range(WINDOW)])

    many = F.size("_m_words") >= WINDOW
    rows = rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("_m_words", "_m_lines")],
        F.size("_m_words").cast("long").alias("n_words"), F.size("_m_lines").cast("long").alias("n_lines"),
        (F.size("_m_lines") - F.size(F.array_distinct("_m_lines"))).cast("long").alias("n_dup_lines"),
        F.when(many, F.transform(F.sequence(F.lit(0), F.size("_m_words") - WINDOW), window))
        .otherwise(F.array().cast("array<bigint>")).alias("_m_windows"))
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    rows = rows.withColumn("_m_sorted", F.when(
        F.size(F.array_distinct("_m_windows")) < F.size("_m_windows"),
        F.sort_array(F.transform("_m_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    alike = F.filter("_m_sorted", lambda x, k: (
        ((k > 0) & (F.get("_m_sorted", k - 1)["h"] == x["h"]))
        | ((k + 1 < F.size("_m_sorted")) & (F.get("_m_sorted", k + 1)["h"] == x["h"]))))
    rows = rows.withColumn("_m_places", F.when(F.size("_m_sorted") > 0, F.sort_array(F.transform(alike, lambda x: x["i"])))
                           .otherwise(F.array().cast("array<int>")))
    # A window adds as many words as lie between its start and the next repeated window's start, five at most.
    covered = F.aggregate(
        F.transform("_m_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_m_places", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    rows = rows.withColumn("n_repeat_words", F.when(F.size("_m_places") > 0, covered).otherwise(F.lit(0).cast("long")))

    def share(part, whole):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return rows.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("_m_upper", "word_chars"),
        "mark_share": share("_m_marks", "word_chars"), "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "mean_word_chars": share("word_chars", "n_words"),
    }).drop("_m_marks", "_m_upper", "_m_windows", "_m_sorted", "_m_places")


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """Exact P(X <= k) for X binomial(n, rate), in logarithms; 1 where k is above n * rate, as no test can pass there."""
    odds = F.lit(rate / (1 - rate))
    first = n * F.log(F.lit(1 - rate))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def add(state, i):
        term = state["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: F.exp(s["total"]))
    return F.when((n > 0) & (k <= n * rate), F.least(total, F.lit(1.0))).otherwise(1.0)


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang",
                   cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, false_rejection: float = FALSE_REJECTION,
                   confidence: float = CONFIDENCE) -> DataFrame:
    """One row per stratum and rule that may be used: stratum, rule, cutoff, good, false_rejected, bad_rejected, p_value.

    The labelled documents are a holdout: the candidate cutoffs are fixed beforehand.  A cutoff is safe in a stratum if
    the exact binomial test refutes, on its good documents (quality 1, toxic 0), that it rejects more of them than the
    rule's share of `false_rejection`.  All tests together keep the error level (Bonferroni over strata, rules and
    cutoffs).  Of a rule's safe cutoffs the one that rejects most bad documents over good ones is taken, the most lenient
    in a tie; a rule that no safe cutoff makes useful stays off.

    Labels are merged to one row per document, the worst label first; null labels and labels of unknown documents count
    for nothing.  A null stratum is a stratum of its own.
    """
    label = labels.groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    known = measured.join(label, F.col("doc_id") == F.col("_labelled")).where("_quality IS NOT NULL AND _toxic IS NOT NULL")
    good = (F.col("_quality") == 1) & (F.col("_toxic") == 0)
    bad = F.col("_quality") == 0

    def tally(condition):
        return F.count(F.when(condition, 1))

    columns = [F.struct(F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cutoff"),
                        tally(good & (F.col(rule) > cut)).alias("false_rejected"),
                        tally(bad & (F.col(rule) > cut)).alias("bad_rejected")) for rule, cuts in cutoffs.items() for cut in cuts]
    counted = known.groupBy(F.col(stratum).alias("stratum")).agg(
        tally(good).alias("good"), *[c.alias(f"_c{k}") for k, c in enumerate(columns)])
    tests = counted.select("stratum", "good", F.explode(F.array(*[F.col(f"_c{k}") for k in range(len(columns))])).alias("t"),
                           (F.count("*").over(_everything()) * len(columns)).alias("_tests")).select("stratum", "good", "_tests", "t.*")
    tested = tests.withColumn("p_value", binomial_tail(F.col("good"), F.col("false_rejected"), false_rejection / len(cutoffs)))
    safe = tested.where((F.col("p_value") <= (1 - confidence) / F.col("_tests"))
                        & (F.col("bad_rejected") > F.col("false_rejected")))
    best = F.max_by(F.struct("cutoff", "good", "false_rejected", "bad_rejected", "p_value"),
                    F.struct(F.col("bad_rejected") - F.col("false_rejected"), F.col("cutoff")))
    return safe.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """docs, without the text, with the measures, base_failed, the first rule failed in name order, and kept.

    Each text is read once; the measures, a few numbers per document, are written and serve both to choose the cutoffs
    and to apply them.  base_failed: fewer than 10 words, or more than a fifth of the words in repeated windows.
    """
    measured = written(text_measures(docs), "measures")
    chosen = choose_cutoffs(measured, labels, stratum, **options)
    # One row per stratum, of which there are as many as languages.
    per = chosen.groupBy(F.col("stratum").alias("_stratum")).pivot("rule", sorted(options.get("cutoffs", CUTOFFS))).agg(F.first("cutoff"))
    rules = sorted(options.get("cutoffs", CUTOFFS))
    per = per.select("_stratum", *[F.col(r).alias(f"_cut_{r}") for r in rules])
    failed = F.coalesce(*[F.when(F.col(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in rules])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (measured.join(per, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
            .withColumn("base_failed", base).withColumn("failed_rule", failed)
            .withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
            .drop("_stratum", *[f"_cut_{r}" for r in rules]))


def drop_failed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the documents that `judge` rejects; the verdicts, ids and hashes only, are joined back to the texts."""
    row = F.xxhash64("text")
    verdicts = judge(docs.select("doc_id", "text", "lang", row.alias("text_hash")), labels, **options)
    failed = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(failed, F.col("doc_id").eqNullSafe(F.col("__id")) & (row == F.col("__hash")), "left_anti")

import collections
import math
import re

from edge import edge_docs, edge_rows, no_docs, prose
from pyspark.sql import functions as F

from catalogspark.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    more = [(100, "a b c d e a b c d e f", "en", "x"), (101, "x x x x x x x", "en", "x"), (102, "l1 a\n\nl1 a\n \nl1 a\n l1 a", "en", "x"),
            (103, " ".join(["one two three four five six"] * 3) + " # < >|", "en", "x"), (104, "z" * 5000 + "　ideographic space", "en", "x")]
    rows = [*edge_rows(), *more]
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "kept").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = R.text_measures(docs).select("doc_id", *R.COUNTS).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *counts(t)) for i, t, *_ in rows), key=key)


def binomial(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 30, 400, 1500) for k in (0, 1, 3, 9) if k <= n]
    frame = spark.createDataFrame(cases, "n long, k long").withColumn("p", R.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in frame.collect():
        want = binomial(r.n, r.k, 0.01) if r.k <= r.n * 0.01 else 1.0
        assert abs(r.p - want) < 1e-9
    large = spark.createDataFrame([(5_000_000, 49_000)], "n long, k long").select(R.binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    assert 0 < large < 1e-4


def labelled(spark, good=1500, bad=300):
    """Good and bad documents of two languages; one in two hundred good ones looks bad."""
    rows, labels = [], []
    for i in range(good + bad):
        ill = i >= good or i % 200 == 0
        text = prose(i, 14)
        rows.append((i, " ".join(w + "##" for w in text.split()) if ill else text, "en" if i % 10 else "de"))
        labels.append((i, int(i < good), 0))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_cutoffs_hold_the_promise_in_each_stratum(spark):
    docs, labels = labelled(spark)
    measured = R.text_measures(docs)
    chosen = {(r.stratum, r.rule): r for r in R.choose_cutoffs(measured, labels).collect()}
    row = chosen["en", "symbol_share"]
    tests = 2 * sum(map(len, R.CUTOFFS.values()))
    assert row.bad_rejected >= 260 and row.good == 1350
    assert abs(row.p_value - binomial(row.good, row.false_rejected, 0.05 / len(R.CUTOFFS))) < 1e-9 and row.p_value <= 0.05 / tests
    # 150 labels can't refute a false rejection of less than a hundredth, so the rule stays off there.
    assert not [k for k in chosen if k[0] == "de"]
    judged = R.judge(docs, labels)
    kept = {r.lang: r.n for r in judged.where("kept").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert kept["de"] == 180 and 1335 <= kept["en"] <= 1360
    assert R.drop_failed(docs, labels).count() == sum(kept.values())


def test_edge_documents(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    judged = R.judge(docs, labels)
    for r in judged.collect():
        assert r.kept == (r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words)
    assert judged.count() == docs.count() and judged.where("lang IS NULL").count() == 1
    kept = R.drop_failed(docs, labels)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    assert R.judge(no_docs(spark), labels).count() == 0 and R.judge(docs, labels.limit(0)).count() == docs.count()


def test_no_python_in_the_plan(spark):
    docs, labels = labelled(spark, 20, 5)
    for frame in (R.text_measures(docs), R.judge(docs, labels), R.drop_failed(docs, labels)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan

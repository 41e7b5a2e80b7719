import math
import random

import numpy as np
from edge import edge_docs, no_docs, prose
from pyspark.sql import functions as F

from catalogspark.llm import classifier as C

LABELS = "doc_id long, quality int, toxic int, score int"


def corpus(spark, n=360):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        text, kind = prose(1000 + i, 30 + i % 50), i % 6
        if kind == 0:
            text += " you vile wretch. " + prose(i, 10)
        elif kind == 1:
            text = " ".join(w + "$$$" if rng.random() < 0.8 else w for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if kind == 1 else 1, int(kind == 0), 5))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_documents_are_graded(spark):
    docs, labels = corpus(spark)
    got = C.classify(docs, labels.where("doc_id < 240")).where("doc_id >= 240").collect()
    right = sum(r.kept == (r.doc_id % 6 > 1) for r in got)
    assert len(got) == 120 and right >= 116, right
    mean = {k: sum(r.expected_grade for r in got if r.doc_id % 6 == k) / 20 for k in (0, 1, 3)}
    assert mean[0] < mean[1] < mean[3]
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)


def test_real_labels_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = C.classify(docs, labels.where(~fold)).join(labels.where(fold), "doc_id")
    by = {tuple(r)[0]: r for r in got.groupBy((F.col("quality") * (1 - F.col("toxic"))).alias("good")).agg(
        F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert by[1]["kept"] > 0.95 and by[0]["kept"] < 0.35


def test_edge_documents(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame(
        [(4, 1, 0, 0), (4, 0, 0, 0), (5, 1, None, 0), (None, 1, 0, 0), (9, 1, 1, 0), (8, 1, 0, 0), (777, 0, 0, 0)], LABELS)
    got = C.classify(docs, labels)
    assert got.count() == docs.count() and got.where("kept IS NULL OR score IS NULL").count() == 0
    assert C.classify(no_docs(spark), labels).count() == 0
    # Without labels, or with one grade only, nothing is rejected.
    assert C.classify(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert C.classify(docs, labels.where("doc_id = 8")).where("kept").count() == docs.count()
    with_text = C.classify(docs, labels, keep_text=True, prefix="__")
    assert set(docs.columns) < set(with_text.columns) and with_text.where("score = 's'").count() == docs.count()


def test_reruns_agree(spark):
    docs, labels = corpus(spark, 90)
    one, two = ({r.doc_id: r.score for r in C.classify(d, labels).collect()} for d in (docs, docs.repartition(5)))
    assert one == two


def log_likelihood(grade, score, cuts):
    """Of one document under the cumulative-link model, by its definition."""
    upto = [1 / (1 + math.exp(-(c - score))) for c in cuts] + [1.0]
    return math.log(upto[grade] - (upto[grade - 1] if grade else 0.0))


def slope(f, x, h=1e-5):
    return (f(x + h) - f(x - h)) / (2 * h)


def test_fit_equals_a_plain_twin_with_numerical_gradients():
    rng = random.Random(12)
    docs = []
    for k in range(50):
        grade = k % 3
        docs.append((grade, sorted({rng.randrange(12) for _ in range(5)} | {20 + grade} | ({30} if grade else set()))))
    used, weights, cuts = C.fit_rows([(g, np.array(f, "i4")) for g, f in docs])

    # The twin: features that lean, then the same order of documents, each step along the numerical gradient.
    number = {f: sum(f in d for _, d in docs) for f in range(40)}
    useful = set()
    for k in range(2):
        usual = sum(g <= k for g, _ in docs) / 50
        for f, n in number.items():
            low = sum(g <= k and f in d for g, d in docs)
            if n >= C.MIN_DOCS and abs(low - n * usual) > C.MIN_LEAN * math.sqrt(max(n * usual * (1 - usual), 1e-9)):
                useful.add(f)
    assert useful >= {20, 22} and not useful & set(range(12))
    w, seen = dict.fromkeys(useful, 0.0), dict.fromkeys(useful, 1e-2)
    counts = [sum(g == k for g, _ in docs) + 1 for k in range(3)]
    c = [math.log(p / (1 - p)) for p in (counts[0] / 53, (counts[0] + counts[1]) / 53)]
    c_seen, order = [1.0, 1.0], np.random.default_rng(7)
    for _ in range(C.EPOCHS):
        for at in order.permutation(50):
            grade, found = docs[at][0], [f for f in docs[at][1] if f in useful]
            score = sum(w[f] for f in found)
            by_score = slope(lambda s: log_likelihood(grade, s, c), score)
            by_cut = [slope(lambda v: log_likelihood(grade, score, [v if j == k else c[j] for j in range(2)]), c[k]) for k in range(2)]
            for f in found:
                step = by_score - C.RIDGE * w[f]
                seen[f] += step * step
                w[f] += C.RATE * step / math.sqrt(seen[f])
            for k in (grade, grade - 1):
                if 0 <= k < 2:
                    c_seen[k] += by_cut[k] ** 2
                    c[k] += C.RATE * by_cut[k] / math.sqrt(c_seen[k])
            c = [c[0], max(c[0], c[1] + 1e-6)]
    assert set(used.tolist()) == useful and cuts[0] < cuts[1]
    assert max(abs(weights[i] - w[f]) for i, f in enumerate(used.tolist())) < 1e-3
    assert max(abs(a - b) for a, b in zip(cuts, c)) < 1e-3
    before = sum(log_likelihood(g, 0.0, [math.log(counts[0] / (53 - counts[0])), math.log((53 - counts[2]) / counts[2])]) for g, _ in docs)
    assert sum(log_likelihood(g, sum(w.get(f, 0) for f in d), c) for g, d in docs) > before


def test_expected_grade_is_the_sum_of_the_tails(spark):
    docs, labels = corpus(spark, 120)
    used, weights, cuts = C.fit(docs, labels)
    table = dict(zip(np.frombuffer(used, "i4").tolist(), np.frombuffer(weights, "f4").tolist()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in C.classify(docs, labels).collect():
        score = sum(table.get(f, 0.0) for f in C.features(texts[r.doc_id]))
        tails = [1 / (1 + math.exp(c - score)) for c in cuts]
        assert abs(r.score - score) < 1e-4 and abs(r.expected_grade - sum(tails)) < 1e-4 and abs(r.tail_probability - tails[1]) < 1e-4


def test_labels_of_documents_that_are_not_there_use_up_nothing(spark):
    docs, labels = corpus(spark, 60)
    strangers = spark.range(1000, 4000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic", "5 AS score")
    assert C.training_rows(docs, labels.unionByName(strangers.selectExpr("doc_id", "CAST(quality AS INT) quality", "CAST(toxic AS INT) toxic",
                                                                         "CAST(score AS INT) score")), 50).count() == 50

import re

from edge import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from catalogspark.llm import fingerprints as P


def paragraphs(text):
    return {p.strip(" ") for p in re.findall(P.PASSAGE, text or "") if p.strip(" ")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edge_documents(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    texts = dict(r[:2] for r in rows)
    ids = sorted(texts)
    got = P.compare_edited(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert by[i].n_chars == len(text)
        assert abs(by[i].near_edited - jaccard(paragraphs(text), paragraphs(edited))) < 1e-12
        assert abs(by[i].near_next - jaccard(paragraphs(text), paragraphs(after))) < 1e-12
    assert by[5].fingerprint == by[6].fingerprint != by[7].fingerprint
    assert by[None].near_next == 0.0
    assert P.compare_edited(no_docs(spark)).count() == 0


def sets(spark, common, one, other):
    return spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(common + one)), lambda i: F.xxhash64(i)).alias("a"),
        F.filter(F.transform(F.sequence(F.lit(1), F.lit(common + one + other)), lambda i: F.when((i <= common) | (i > common + one), F.xxhash64(i))),
                 lambda d: d.isNotNull()).alias("b"))


def test_peeling_recovers_what_differs_and_larger_sketches_follow(spark):
    for common, one, other in ((1000, 4, 3), (500, 60, 80), (0, 3000, 10), (7, 0, 0)):
        frame = sets(spark, common, one, other).select("*", P.sketch(F.col("a")).alias("ac"), P.sketch(F.col("b")).alias("bc"))
        own = P.peel(P.subtract(F.col("ac"), F.col("bc")), P.CELLS, F.lit(12))
        row = frame.select("a", "b", own.alias("own"), P.differing("a", "b", "ac", "bc").alias("d")).first()
        assert set(row.d) == set(row.a) ^ set(row.b) and len(row.d) == one + other
        assert row.own is None if one + other > 12 else row.own is None or set(row.own) == set(row.d)


def test_a_ladder_rung_that_fails_is_followed_by_a_larger_one(spark):
    frame = sets(spark, 0, 12, 0)
    small = P.peel(P.sketch(F.col("a"), 1), 1, F.lit(12))
    large = P.peel(P.sketch(F.col("a"), 48), 48, F.lit(12))
    row = frame.select(small.alias("small"), large.alias("large"), "a").first()
    assert row.small is None and set(row.large) == set(row.a)


def test_no_python_in_the_plan(spark):
    plan = P.compare_edited(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_sentences_and_long_unmarked_lines_keep_their_likeness(spark):
    short = [f"Line {k} says this. Then that {k}! And {k} more?" for k in range(2)]
    words = [" ".join(f"{c}{(k * k) % 97}ord{k % 7} and" for k in range(300)) for c in "wv"]
    docs = spark.createDataFrame(list(enumerate([*short, *words])), "doc_id long, text string")
    by = {r.doc_id: r for r in P.compare_edited(docs).collect()}
    assert by[0].near_edited > 0 and by[2].near_edited > 0.2
    # An insertion into a long run changes the passages near it, not those after it.
    shifted = words[0][:50] + "something new " + words[0][50:]
    assert jaccard(paragraphs(words[0]), paragraphs(shifted)) > 0.8
    assert max(map(len, paragraphs("z" * 1000))) <= 300

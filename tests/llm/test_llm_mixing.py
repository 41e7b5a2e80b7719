from edge import edge_docs, no_docs, prose
from pyspark.sql import functions as F

from catalogspark.llm import mixing as M


def targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Brute force: share out, stop, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > repeats * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: repeats * sizes[s] for s in over}
        left -= sum(repeats * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_and_taken(spark):
    rows = [(i, prose(i, 5 + i * 37 % 60), [None, "a", "b", "ü", "hot", "hot", "hot"][i % 7]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = M.mix_plan(docs).collect()
    sizes = {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = targets(sizes)
    for source in sizes:
        own = [r for r in plan if r.source == source]
        assert all(abs(r.target - want[source]) < 1e-6 and r.source_size == sizes[source] for r in own)
        assert abs(sum(r["size"] * r.times for r in own) - want[source]) <= 65
        assert all(0 <= r.times <= 2 for r in own)
    again = M.mix_plan(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.times) for r in plan) == sorted((r.doc_id, r.times) for r in again)
    assert sum(r["size"] * r.times for r in plan) <= 1.5 * sum(sizes.values())


def test_mix_takes_effect(spark):
    docs = edge_docs(spark)
    plan = M.mix_plan(docs)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    count = mixed.groupBy("doc_id").count()
    got = {r.doc_id: r["count"] for r in count.collect()}
    want = {}
    for r in plan.collect():
        n = r.copies * (1 if r["size"] == 0 else r.times)
        want[r.doc_id] = want.get(r.doc_id, 0) + n
    assert got == {k: n for k, n in want.items() if n}
    assert plan.agg(F.sum("copies")).first()[0] == docs.count()


def test_empty_and_wordless(spark):
    assert M.mix(no_docs(spark)).count() == 0 and M.mix_plan(no_docs(spark)).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert M.mix(wordless).count() == 2
    assert {(r["size"], r.target) for r in M.mix_plan(wordless).collect()} == {(0, 0.0)}

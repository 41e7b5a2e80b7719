import random

from edge import edge_docs, edge_rows, no_docs, prose
from pyspark.sql import functions as F

from catalogspark.llm import neardup as N


def sets(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent):
    """doc_id -> smallest doc_id reachable, comparing everything with everything."""
    shingled = [(i, sets(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(shingled):
        for j, b in shingled[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                one, two = sorted((root(i), root(j)))
                parent[two] = one
    return {i: root(i) for i, _ in rows}


def family(seed, base_words, members, edits):
    """Near copies of one text: each with its own number of changed words."""
    rng, base = random.Random(seed), prose(seed, base_words).split()
    texts = []
    for k in range(members):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_hot_families_without_missing_links(spark):
    passage = prose(99, 60)
    texts = family(1, 150, 170, 14) + family(2, 60, 90, 5) + family(3, 400, 60, 40)
    texts += [f"{prose(500 + i, 20 + i)} {passage} {prose(900 + i, 30)}" for i in range(60)]
    texts += ["exact copy of a short text in many rows"] * 150 + [t.upper() for t in family(1, 150, 20, 14)]
    random.Random(7).shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    for percent in (85, 80):
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets(dict(rows)[r.doc_id])) for r in got)


def test_classes_that_only_meet_around_a_hub(spark):
    # Both differ from the hub by a fifth, in the same places but for one word: linked with each other, not with it.
    base = prose(5, 100).split()
    far = list(base)
    for k in range(3, 100, 11):
        far[k] = f"other{k}"
    near = list(far)
    near[50] = "last"
    texts = [" ".join(w) for w in (base, far, near)] + family(5, 100, 40, 3)
    rows = list(enumerate(texts))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85)


def test_signatures_estimate_similarity():
    one, two = (N.shingles(t) for t in family(8, 300, 2, 30))
    truth = len(set(one) & set(two)) / len(set(one) | set(two))
    keys = N.band_keys([one, two], rows=1, bands=600)
    assert abs((keys[0] == keys[1]).mean() - truth) < 0.08


def test_edge_documents(spark):
    got = N.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    rows = {r[0]: r[1] for r in edge_rows() if r[0] is not None}
    want = brute(list(rows.items()), 85)
    assert {i: by[i].component_id for i in rows} == want
    assert by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 3)) and by[4].n_shingles == 1
    assert N.near_duplicates(no_docs(spark)).count() == 0


def test_one_document_of_a_component_stays(spark):
    docs = edge_docs(spark)
    kept = N.drop_near_duplicates(docs, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute([(r[0], r[1]) for r in {r[0]: r for r in edge_rows() if r[0] is not None}.values()], 80)
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c}) and ids.count(None) == 1


def test_components_of_long_chains(spark):
    links = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = N.components(links.union(spark.createDataFrame([(1000, 999)], "a long, b long"))).collect()
    assert {r.node: r.label for r in got} == {**{k: 0 for k in range(301)}, 999: 999, 1000: 999}
    assert N.components(links.limit(0)).count() == 0

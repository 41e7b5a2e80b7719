import random

import numpy as np
import pytest
from edge import edge_docs, edge_rows, no_docs, prose
from pyspark.sql import functions as F

from catalogspark.llm import setjoin as S
from catalogspark.llm.neardup import shingles


def sets(text, width=4):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent=85, width=4):
    """doc_id -> (set size, smallest doc_id with the same set, smallest reachable), comparing all with all."""
    found = [(i, sets(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(found):
        for j, b in found[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                one, two = sorted((root(i), root(j)))
                parent[two] = one
    return {i: (len(a), min(j for j, b in found if b == a) if a else i, root(i)) for i, a in found}


def family(seed, words, members, edits):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(members):
        changed = list(base)
        for _ in range(rng.randrange(edits)):
            changed[rng.randrange(len(changed))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(changed[:len(changed) - rng.randrange(1 + words // 20)]))
    return out


def result(frame, *args):
    return {r.doc_id: (r.n_shingles, r.class_id, r.component_id) for r in S.join_sets(frame, *args).collect()}


def test_equals_all_pairs(spark):
    passage = prose(77, 50)
    texts = family(1, 150, 130, 14) + family(2, 60, 60, 5) + family(3, 300, 40, 30) + family(4, 12, 40, 3)
    texts += [f"{prose(500 + k, 10 + 2 * k)} {passage} {prose(900 + k, 30)}" for k in range(60)]
    texts += ["one short text in many rows"] * 90 + [t.upper() for t in family(1, 150, 15, 14)] + ["a b c", "A  b\nc", "d", "D", ""]
    random.Random(5).shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(frame) == brute(rows)
    assert result(frame, 70, 2, 0) == brute(rows, 70, 2)         # no element is put last


def test_links_between_classes_that_only_meet_in_a_block(spark):
    base = prose(5, 100).split()
    far = list(base)
    for k in range(3, 100, 11):
        far[k] = f"other{k}"
    near = list(far)
    near[50] = "last"
    rows = list(enumerate([" ".join(w) for w in (base, far, near)] + family(5, 100, 40, 3)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_every_linked_pair_meets_in_a_block(spark):
    rng, rows = random.Random(9), []
    for k in range(60):
        n = rng.randrange(1, 120)
        base = [f"w{rng.randrange(10**9)}" for _ in range(n + 3)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[rng.randrange(1 + n // 15):]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sized = S.ordered_sets(frame, []).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "starts")
    blocks = {}
    for r in S.index_blocks(sized).collect():
        blocks.setdefault((r.element, r.block), []).append((r.node, r.small))
    met = {frozenset((a, b)) for m in blocks.values() for a, small in m for b, _ in m if small and a != b}
    full = {i: set(shingles(t, 4).tolist()) for i, t in rows}
    for k in range(60):
        a, b = full[2 * k], full[2 * k + 1]
        if 100 * len(a & b) >= 85 * len(a | b):
            assert frozenset((2 * k, 2 * k + 1)) in met
    # Every list holds one pair here; where its elements lie too far into the sets, no block lets the two meet.
    lists = {element for element, _ in blocks}
    assert len({element for (element, _), m in blocks.items() if len(m) > 1 and any(small for _, small in m)}) < 0.7 * len(lists)


def test_frequent_elements_are_of_different_sets(spark):
    rows = [(k, "exact copy of one text") for k in range(40)] + [(100 + k, f"{prose(k, 20)} shared by all of them {prose(60 + k, 9)}") for k in range(30)]
    found = S.frequent_elements(spark.createDataFrame(rows, "doc_id long, text string"), one_in=1, least=20)
    assert sorted(found.tolist()) == sorted(shingles("shared by all of them", 4).view("i8").tolist())
    assert len(S.frequent_elements(spark.createDataFrame(rows, "doc_id long, text string"), one_in=1, least=2, most=1)) <= 1


def test_edge_documents(spark):
    got = S.join_sets(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: (r.n_shingles, r.class_id, r.component_id) for r in got}
    assert by.pop(None)[1:] == (None, None)
    assert by == brute(list({r[0]: r[1] for r in edge_rows() if r[0] is not None}.items()))
    assert S.join_sets(no_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="doc_id"):
        S.join_sets(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_common_elements_beyond_the_most_frequent_lead_no_pairs(spark, monkeypatch):
    """Far more elements are shared than may be frequent: texts that share only such passages are in no list together."""
    rng = random.Random(3)
    passages = [prose(2000 + k, 12) for k in range(40)]
    texts = [" ".join(f"{prose(10_000 + 10 * k + i, 10)} {p}" for i, p in enumerate(rng.sample(passages, 6))) for k in range(240)]
    rows = list(enumerate(texts + family(4, 120, 10, 8)))
    counts, made = [], S.leader_pairs

    def counted(*args):
        pairs = made(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(S, "leader_pairs", counted)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 85, 4, 8) == brute(rows)
    assert counts[0] < 120, counts


def test_a_sieve_loses_nothing_and_lets_little_through(spark):
    hashes = [h for t in range(60) for h in shingles(prose(t, 60), 4).view("i8").tolist()]
    words = S.sieve(spark.createDataFrame([(h,) for h in hashes], "hash long").repartition(5), len(hashes))
    others = np.unique(np.concatenate([shingles(prose(100 + t, 60), 4) for t in range(60)]))
    assert S.passes(np.array(hashes, "i8").view("u8"), words).all() and S.passes(others, words).mean() < 0.1
    assert not S.passes(others, S.sieve(spark.createDataFrame([], "hash long"), 0)).any()


def test_asked_texts_are_those_of_id_and_hash(spark):
    docs = spark.createDataFrame([(k, prose(k, 20)) for k in range(400)] + [(7, "another text of seven"), (None, prose(8, 20))], "doc_id long, text string")
    asked = docs.where("doc_id IN (7, 8) AND text <> 'another text of seven'").select(
        (F.col("doc_id") + 100).alias("node"), "doc_id", F.xxhash64("text").alias("text_hash"))
    found = S.asked_texts(docs, asked)
    assert sorted(map(tuple, found.collect())) == [(107, prose(7, 20)), (108, prose(8, 20))]


def test_only_elements_that_two_nodes_of_a_leader_have_go_on(spark):
    rng, told = random.Random(8), []
    for leader, nodes, slices in ((1, 2, 1), (2, 40, 3), (3, 1, 1), (4, 5, 1)):
        for node in range(nodes):
            told.append((leader, 100 * leader + node, 9, rng.sample(range(-200, 200), rng.randrange(12)), slices))
    frame = spark.createDataFrame(told, "leader long, node long, size int, first array<long>, slices int").repartition(4)
    want = sorted((leader, node, 9, i, e) for leader, node, _, first, _ in told for i, e in enumerate(first)
                  if any(e in f for a, b, _, f, _ in told if a == leader and b != node))
    got = S.shared_elements(frame).select("leader", "node", "size", "i", "element")
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < sum(len(t[3]) for t in told)

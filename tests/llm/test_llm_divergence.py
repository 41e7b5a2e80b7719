import random
import re
from collections import Counter

import numpy as np
from edge import edge_docs, no_docs, prose

from catalogspark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, ranks=200):
    """(lang, source, part, item, value, rank) by the definition, in whole numbers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    per, having = {}, {}
    for lang, source, text in rows:
        found = Counter(TERM.findall(text.translate(LOWER)))
        per.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        having.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang, sources in per.items():
        kept = [t for t, n in having[lang].items() if n >= least]

        def shares(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + D.SCALE * (counts[t] + 1) // size for t in kept}

        of = {s: shares(c) for s, c in sources.items()}
        whole = shares(sum(sources.values(), Counter()))
        price = lambda p, q: (p - q) * (p - q) // q
        for s, p in of.items():
            lists = {"pair": [(o, sum(price(p[t], q[t]) for t in kept)) for o, q in of.items() if o != s],
                     "term": [(t, price(p[t], whole[t])) for t in kept if sources[s][t] and p[t] > whole[t]]}
            for part, items in lists.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de", "en"]), "big" if rng.random() < 0.4 else f"s{rng.randrange(9)}",
             " ".join(f"{chr(97 + rng.randrange(26))}é{'xy' * rng.randrange(3)}" for _ in range(rng.randrange(60)))) for _ in range(n)]


def test_equals_the_definition_over_many_blocks(spark):
    rows = texts(3, 400) + [("xx", "alone", prose(1, 30)), ("yy", "a", "rare"), ("yy", "b", None), ("zz", "a", "!1"), ("zz", "b", "")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    want = brute(rows)
    assert sorted(map(tuple, D.audit(frame).collect())) == want
    found = D.Audit(frame)
    pairs = sorted((*r[:3], r.value) for r in found.pairs(block=8, part=3).collect())
    assert pairs == sorted((lang, s, item, v) for lang, s, part, item, v, _ in want if part == "pair")
    assert sorted(map(tuple, D.audit(frame, ranks=4).collect())) == brute(rows, ranks=4)


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 0, 1, 0, 1, 0, 1, 0], [1, 0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0, 1, 0]])
    roots, levels, values = D.build_trees(counts)
    assert len(set(roots.tolist())) == 3 and values.tolist() == [0, 1]
    assert [len(left) for left, _ in levels] == [3, 2, 2]  # below the roots: (10 10) and (00 00), then (1 0) and (0 0)


def test_large_counts_are_exact():
    size = np.array([9 * 10**15 - 1, 7, 10**12 + 39], "i8")
    count = np.array([8 * 10**15 + 12345, 7, 1], "i8")
    assert D._shares(count, size).tolist() == [1 + D.SCALE * int(c) // int(s) for c, s in zip(count, size)]


def test_edge_documents(spark):
    docs = edge_docs(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, D.audit(docs).collect())) == brute(rows)
    assert D.audit(no_docs(spark)).count() == 0

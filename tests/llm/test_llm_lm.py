import collections
import math
import zlib

from edge import edge_docs, edge_rows, no_docs, prose

from catalogspark.llm import lm as L


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, weights):
    """Base and model scores straight from the formulas."""
    ones, pairs, starts = collections.Counter(), collections.Counter(), 0
    for doc_id, text in rows:
        if not held(doc_id):
            words = tokens(text)
            ones.update(words)
            pairs.update(zip(["<s>", *words], words))
            starts += 1
    total, types = sum(ones.values()), len(ones)
    out = []
    for doc_id, text in rows:
        base = score = 0.0
        for before, word in zip(["<s>", *tokens(text)], tokens(text)):
            seen = starts if before == "<s>" else ones[before]
            two, one, zero = weights(seen)
            p = two * (pairs[before, word] / seen if seen else 0) + one * ones[word] / max(total, 1) + zero / (types + 1)
            base += math.log10((ones[word] + 1) / (total + types + 1))
            score += math.log10(p)
        out.append((doc_id, held(doc_id), len(tokens(text)), sum(ones[w] > 0 for w in tokens(text)), total, base, score))
    return out


def corpus():
    return [(i, " ".join(["alpha beta gamma", prose(i % 40, 30), "ALPHA beta delta"])) for i in range(200)]


def compare(spark, frame, rows, monkeypatch, **options):
    caught = {}
    fit = L.fit_weights
    monkeypatch.setattr(L, "fit_weights", lambda cells, uniform: caught.setdefault("w", fit(cells, uniform)))
    got = L.score_texts(frame, **options).collect()

    def weights(seen):
        bucket = 0 if seen == 0 else seen.bit_length()
        near = min(caught["w"], key=lambda b: (abs(b - bucket), b), default=None)
        return (0.0, 0.5, 0.5) if near is None else caught["w"][near]

    want = brute(rows, weights)
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(g[5:], w[5:])), (g, w)
    return got, caught["w"]


def test_scores_equal_the_formulas_whatever_the_blocks(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, weights = compare(spark, frame.repartition(3), rows, monkeypatch, block_tokens=700, slices=13)
    assert all(abs(sum(w) - 1) < 1e-9 and min(w[1:]) > 0 for w in weights.values())
    two = L.score_texts(frame.coalesce(1), slices=2).collect()
    assert {r.doc_id: round(r.score, 6) for r in one} == {r.doc_id: round(r.score, 6) for r in two}
    # Held-out text of the same kind is better predicted than by single words.
    assert sum(r.score for r in one if r.held_out) > sum(r.base_score for r in one if r.held_out)


def test_edge_documents(spark, monkeypatch):
    compare(spark, edge_docs(spark), [r[:2] for r in edge_rows()], monkeypatch)
    assert L.score_texts(no_docs(spark)).count() == 0


def test_weights_find_the_mixture():
    # Words follow the pair estimate seven times in ten, the single one twice, and none of them once.
    cells = [(3, 1.0, 1e-4, 700.0), (3, 0.0, 0.5, 200.0), (3, 0.0, 0.0, 100.0), (0, 0.0, 0.1, 10.0)]
    weights = L.fit_weights(cells, 1e-6)
    assert abs(weights[3][0] - 0.7) < 0.02 and abs(weights[3][1] - 0.2) < 0.02 and weights[0][0] == 0.0

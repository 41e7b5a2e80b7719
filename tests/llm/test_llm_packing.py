import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import edge_docs, edge_rows, no_docs
from pyspark.errors import PySparkException

from catalogspark.llm import packing as P
from catalogspark.llm.common import IdEncoder

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        places.sort(key=lambda p: (p[0], p[1]))
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_are_the_tokens_of_whole_texts(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(FILE)
    want = []
    for doc_id, text, *_ in edge_rows():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, k, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()))
                 for k, s in enumerate(range(0, len(ids), 4096))]
    got = P.pack(P.token_pieces(edge_docs(spark), FILE)).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert check(got, 4096) == math.ceil(sum(r.length for r in got) / 4096)
    assert P.pack(P.token_pieces(no_docs(spark), FILE)).count() == 0


def test_hard_lengths_come_near_the_bound_in_several_blocks(spark):
    rng = np.random.default_rng(5)
    lengths = [int(n) for n in rng.integers(20, 70, 900)] + [0, 100, 100, 1]
    frame = spark.createDataFrame([(k, n, "x", 1) for k, n in enumerate(lengths)], "doc_id long, length long, text string, items int")
    got = P.pack(frame, 100, block=128, islands=3, epochs=2).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted(enumerate(lengths))
    # No more bins than one best-fit pass over everything, but for a part of a bin in each of the eight blocks.
    bins, _ = P.packed(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, 100)
    assert check(got, 100) <= len(bins) + 8


def test_genetic_search_beats_best_fit():
    # Three pieces of 34, 33 and 33 fill a bin; best fit by size puts two of 34 together.
    lengths = [34, 33, 33] * 6 + [50, 26, 24] * 6
    start, _ = P.packed(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, 100)
    assigned = P.evolve(lengths, 100, [], seed=3, generations=400)
    fills = np.bincount(assigned, lengths)
    assert fills.max() <= 100 and max(assigned) + 1 <= len(start)
    migrant = [k // 3 for k in range(len(lengths))]
    assert max(P.evolve(lengths, 100, [assigned, migrant], seed=4)) + 1 == 12


def test_search_goes_on_as_long_as_it_gains():
    rng = np.random.default_rng(1)
    pairs = [(int(rng.integers(1030, 2000)), int(rng.integers(1030, 1066))) for _ in range(100)]
    lengths = [n for one, other in pairs for n in (one, other, 4096 - one - other)]
    start, _ = P.packed(sorted(range(300), key=lambda i: -lengths[i]), lengths, 4096)
    assigned = P.evolve(lengths, 4096, [], seed=1)
    assert len(assigned) == 300 and np.bincount(assigned, lengths).max() <= 4096
    # Of the bins that best fit wastes, more than half are saved.
    assert max(assigned) + 1 - 100 < (len(start) - 100) / 2
    assert assigned == P.evolve(lengths, 4096, [], seed=1)


def test_least_bins_is_a_bound_beyond_the_sum():
    import random

    def fewest(lengths, capacity, fills=()):
        if not lengths:
            return len(fills)
        n, rest = lengths[0], lengths[1:]
        places = [fills[:k] + (f + n,) + fills[k + 1:] for k, f in enumerate(fills) if f + n <= capacity]
        return min(fewest(rest, capacity, p) for p in [*places, (*fills, n)])

    draw = random.Random(2)
    for _ in range(300):
        lengths = [draw.randint(0, 10) for _ in range(draw.randint(0, 6))]
        assert -(-sum(lengths) // 10) <= P.least_bins(lengths, 10) <= fewest(lengths, 10)
    assert P.least_bins([6, 6, 6, 1], 10) == 3 and P.least_bins([7, 7, 4, 4], 10) == 3
    assert P.evolve([6] * 50, 10, [], seed=0, generations=10**9)[-1] == 49


def test_a_piece_too_long_is_refused(spark):
    with pytest.raises(PySparkException):
        P.pack(spark.createDataFrame([(1, 11)], "doc_id long, length long"), 10).count()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(FILE), IdEncoder(FILE)
    own.chunks.limit = own.words.limit = 3
    for text in ("", "it's don't 'tis x<|endoftext|> y", "İstanbul ΣΑΣ Å é ﬁ", "a\x0bb c  d.\n\n'", "x" * 300, "１２ 3.4 😀a"):
        for _ in range(3):
            assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library_for_every_letter_before_a_mark():
    import random
    import sys

    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(FILE), IdEncoder(FILE)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    texts = [" ".join(c + mark for c in letters[at:at + 5000]) for mark in (",", "!!", "-") for at in range(0, len(letters), 5000)]
    texts += ["Mehmet, DENİZLİ, TÜRKİYE.", "কড়, xक़- য়!!"]
    rng = random.Random(4)
    some = rng.sample(letters, 400) + list("İक़ড়abcdeXYŹ̧,.!-'’ \t\n09_") * 12
    texts += ["".join(rng.choices(some, k=rng.randrange(1, 25))) for _ in range(50_000)]
    wrong = [t for t, got, want in zip(texts, own.encode(texts), model.encode_batch(texts, add_special_tokens=False))
             if np.frombuffer(got, "<u4").tolist() != want.ids]
    assert not wrong


def test_encoder_sees_a_repeated_word_once_a_call():
    import pyarrow as pa
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(FILE), IdEncoder(FILE)
    texts = ["", " ", "one two\tone\n\ntwo, one", "", "two" * 40 + " é,", " one\r", "two, " * 3000]
    asked, codes = [], own._codes
    own._codes = lambda chunks: asked.extend(chunks) or codes(chunks)
    want = [code.ids for code in model.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(code, "<u4").tolist() for code in own.encode(texts)] == want
    assert len(asked) < 15
    part = pa.array(["cut off", *texts, "cut off"], pa.large_string()).slice(1, len(texts))
    assert [np.frombuffer(code, "<u4").tolist() for code in own.encode(part)] == want
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="at, offset"):
        P.pack(spark.createDataFrame([(1, 5, 0, 0)], "doc_id long, length long, offset long, at long"), 10)

import public_tokenizers
import sentencepiece
from edge import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from catalogspark.llm import token_counts as T
from catalogspark.llm.common import PieceCounter
from catalogspark.session import scratch_path

FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_and_cache(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    cache = scratch_path(spark, "cache")
    docs = edge_docs(spark)
    got = T.count_tokens(docs, cache, FILE)
    assert set(got.columns) == set(docs.columns) - {"text"} | {"n_bytes", "n_tokens", "over_limit"}
    key = lambda r: (r[0] is None, r)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in edge_rows()]
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=key) == sorted(want, key=key)
    # Each distinct text is stored once, and a second run encodes only what is new.
    distinct = len({t or "" for _, t, *_ in edge_rows()})
    assert spark.read.parquet(cache).count() == distinct
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "brand new"), (51, "brand new")], "doc_id long, text string"))
    again = T.count_tokens(more, cache, FILE)
    assert spark.read.parquet(cache).count() == distinct + 1 and again.count() == docs.count() + 2
    # What a repeated job has stored twice, or another tokenizer has counted, changes nothing.
    stored = spark.read.parquet(cache)
    stored.unionByName(stored.withColumns({"tokenizer": F.lit(b"other"), "n_tokens": F.lit(1).cast("long")})).write.mode("append").parquet(cache)
    assert sorted(map(tuple, T.count_tokens(docs, cache, FILE).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=key) == sorted(want, key=key)


def test_no_documents(spark):
    assert T.count_tokens(no_docs(spark), scratch_path(spark, "cache"), FILE).count() == 0


def test_counter_equals_the_library():
    model, own = sentencepiece.SentencePieceProcessor(model_file=FILE), PieceCounter(FILE)
    assert own.by_chunk
    for text in ("", " ", "   ", "a", " a ", "a  b\n  c ", "▁x y▁z", " ▁ ", "x ▁", "<s> </s>", "a\n", "日本 語  字 ", "a" * 300 + "   b"):
        for _ in range(2):
            assert own.count(text) == len(model.encode(text))

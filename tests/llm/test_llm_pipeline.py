"""The stages, each on what the one before has kept, over a folder of small tables."""

import public_tokenizers
import pytest
from edge import edge_docs, edge_rows, prose
from test_llm_neardup import brute, family
from tokenizers import Tokenizer

import corpus_pipeline as P
from catalogspark.session import scratch_path


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Clean documents, toxic and broken ones, copies and near copies, and the awkward ones."""
    folder, rows, labels = str(tmp_path_factory.mktemp("sf")), [], []
    for i in range(400):
        text = prose(3000 + i, 40 + i % 60)
        if i % 8 == 0:
            text += " you vile wretch. vile!"
        elif i % 8 == 1:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((1000 + i, text, "en", f"src{i % 5}"))
        labels.append((1000 + i, int(i % 8 != 1), int(i % 8 == 0)))
    rows += [(2000 + k, t, "de", "src0") for k, t in enumerate(family(77, 120, 30, 4))]
    docs = edge_docs(spark)
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mix_sources", "pack_sequences"]
    kept = {}
    for name, stage in P.STAGES:
        path = scratch_path(spark, name)
        out = stage(spark, docs, sf)
        if name != "pack_sequences":
            assert out.schema == docs.schema or out.columns == docs.columns
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = (before, docs)

    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    clean = {1000 + i for i in range(400) if i % 8 > 1}
    toxic = {1000 + i for i in range(400) if i % 8 == 0}
    first = ids(kept["quality_classifier"][1])
    assert len(first & clean) >= 0.99 * len(clean) and len(first & toxic) <= 2
    second = ids(kept["quality_rules"][1])
    assert second <= first and first & clean <= second and not second & {1, 2, 3, 4, 10}
    before, after = kept["near_dedup"]
    rows = {r.doc_id: r.text for r in before.collect() if r.doc_id is not None}
    assert ids(after) - {None} == set(brute(list(rows.items()), 80).values())
    before, mixed = kept["mix_sources"]
    words = lambda frame: sum(len((r.text or "").encode().split()) for r in frame.collect())
    assert ids(mixed) <= ids(before) and abs(words(mixed) - 1.5 * words(before)) < 200
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert docs.agg({"length": "sum"}).first()[0] == tokens


def test_run_and_reruns(spark, sf):
    one, two = (sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in P.run(spark, sf).collect()) for _ in range(2))
    assert one and one == two
    assert len(edge_rows()) > 0

"""The pipeline's stages on a whole small table, each against what it promises on its own input."""

import corpus_pipeline
from tests.llm.brute import near_components
from tests.llm.test_bpe import expected
from tests.llm.test_line_dedup import brute
from tidewire.llm import mixing, queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, []
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, FOLDER)
        assert place == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    raw, clean, lines, single, mixed = inputs
    toxic = {r.doc_id for r in queries.op1_toxicity(spark, FOLDER).where("predicted = 1").collect()}
    assert {r.doc_id for r in raw.collect()} - {r.doc_id for r in clean.collect()} == toxic and toxic
    after = {k: v[2] for k, v in brute([(r.doc_id, r.text) for r in clean.collect()], 10).items()}
    assert {r.doc_id: r.text for r in lines.collect()} == after and all(r.n_chars == len(r.text) for r in lines.collect())
    assert {r.doc_id for r in single.collect()} == {c for _, c in near_components(after.items()).values()}
    wanted = {r.row.doc_id: r.copies for r in mixing.copies(single).collect() if r.copies}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == wanted
    ids = {r.doc_id: list(r.ids) for r in docs.collect()}
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert list(ids) and ids == dict(zip(texts, expected(texts.values()), strict=True)) and docs.count() == mixed.count()

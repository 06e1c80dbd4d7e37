"""The pipeline's stages one by one on a small corpus."""

import corpus_pipeline
from retentia.llm import decontamination, minhash, suffix_array, toxicity

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{i}"
        stage(spark, docs, sf).write.parquet(out)
        new = spark.read.parquet(out)
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in new.select("doc_id").collect()}
        assert after <= before, name
        if i + 1 < len(corpus_pipeline.STAGES):
            assert new.columns == DOCUMENT
        gone = before - after
        if name == "toxicity":
            toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("toxic").collect()}
            assert gone == toxic and toxic
        elif name == "minhash_near_dedup":
            assert gone == {r.doc_id for r in minhash.near_duplicates(docs, shingle_words=5).where("not kept").collect()}
        elif name == "suffix_array_dedup":
            sizes = {r.doc_id: r.n_removed for r in suffix_array.remove_repeated_bytes(docs).collect()}
            changed = {r.doc_id: r.text for r in new.collect()}
            assert all(changed.get(r.doc_id) == r.text for r in docs.collect() if sizes[r.doc_id] == 0)
        elif name == "decontamination":
            assert gone == {r.doc_id for r in decontamination.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        else:
            assert gone == set()
        docs = new
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0

import corpus_pipeline
from tierline.llm import simhash

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before
        if name == "exact_dedup":
            texts = [" ".join((r.text or "").split()) for r in kept.collect()]
            assert len(texts) == len(set(texts))
        if name == "simhash_near_dedup":
            again = simhash.simhash_components(kept)
            assert again.where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0

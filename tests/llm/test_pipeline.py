"""Stages keep the columns of documents and their decisions take effect."""

import corpus_pipeline


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"
    ]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, small)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        at = corpus_pipeline.materialise(out)
        ids = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert ids <= before and at.count() == len(ids)
        before = ids
    last = corpus_pipeline.STAGES[-1][1](spark, at, small).collect()
    assert {r["doc_id"] for r in last} == before and all(len(r["ids"]) == r["n_tokens"] for r in last)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == before


def test_empty(spark, small, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

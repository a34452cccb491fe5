import corpus_pipeline
from saltfinger.llm import decontaminate, jaccard_join, language_id, suffix_dedup


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id: r.text for r in now.collect()}
        assert set(ids) <= set(kept)
        gone = set(kept) - set(ids)
        if name == "language":
            assert gone == {r.doc_id for r in language_id.identify(docs, language_id.fit(docs)).where("rejected").collect()}
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 5, 80).collect()}
            assert gone == {d for d, c in groups.items() if d != c} and gone
        if name == "repeats":
            left = {r.doc_id: r for r in suffix_dedup.removal_digest(docs, suffix_dedup.PASSAGE).collect()}
            assert gone == {d for d, r in left.items() if r.n_bytes and r.n_bytes == r.n_removed}
            assert all(ids[d] == kept[d] for d in ids if not left[d].n_removed)
            assert all(len(ids[d]) < len(kept[d]) for d in ids if left[d].n_removed > 8)
        if name == "benchmark":
            bad = decontaminate.contamination(docs, spark.read.parquet(f"{small}/benchmark.parquet"))
            assert gone == {r.doc_id for r in bad.collect()}
        kept, docs = ids, now


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_no_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0

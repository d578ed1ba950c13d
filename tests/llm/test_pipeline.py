import corpus_pipeline
from wayspan.llm.common import read, staged


def test_runs(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "size", "bin_id", "bin_offset", "capacity"]
    assert got.select("doc_id").distinct().count() > 50


def test_stages(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, ""), name)
        assert after.dtypes == docs.dtypes
        if name == "near_dedup":
            assert after.count() == after.select("doc_id").distinct().count()
        if name != "mix_sources":
            assert 0.5 * n < after.count() <= n
        docs = after


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, docs, ""), name)
            if name != "best_fit_packing":
                assert out.columns == odd.columns
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, odd, "").collect()
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [1, 2, 5, 7, 8, 9]

import pytest

import corpus_pipeline
from asof_spark.llm import common, near_join, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = common.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.cut(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == first.columns and after.keys() <= before.keys() and all(before[i] == r for i, r in after.items())
        if name == "quality":
            assert after.keys() == {r.doc_id for r in quality.score(first, labels).filter("predicted = 1").collect()}
        if name == "exact_dedup":
            assert after.keys() == set({r.text or "": i for i, r in sorted(before.items())}.values())
        if name == "near_dedup":
            assert near_join.join(docs).filter("n_links > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == after.keys() and packed.groupby("sequence_id").length.sum().max() <= 1024


if __name__ == "__main__":
    pytest.main([__file__])

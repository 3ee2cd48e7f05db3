"""The stages, each by its own rules, over the smallest tables."""

import corpus_pipeline
from loomframe.llm.common import documents


def test_stages(spark, sf_dir):
    docs, counts = documents(spark, sf_dir), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.where("n_tokens <> size(ids)").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())

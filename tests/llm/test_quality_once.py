"""The quality stage judges a text once, however the optimizer moves its filter."""

import corpus_pipeline
from loomframe.llm import op5_quality
from loomframe.llm.common import documents


def judgements(rows):
    """How often the rules on lines are in the plan."""
    return rows._jdf.queryExecution().optimizedPlan().toString().count(op5_quality.SUSPECT)


def test_stage_judges_once(spark, sf_dir):
    docs = documents(spark, sf_dir)
    left = dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, sf_dir)
    assert judgements(left) == judgements(op5_quality.quality(docs)) == 1
    wanted = op5_quality.quality(docs).where("_q.kept").selectExpr("doc_id", "_q.clean AS text")
    found = left.select("doc_id", "text")
    assert found.count() == wanted.count() > 0
    assert found.exceptAll(wanted).isEmpty()

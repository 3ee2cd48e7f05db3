"""All stages on one awkward table: null ids and texts, repeated ids with other texts, names that operators might use, long texts."""

import random

import pytest

import corpus_pipeline
from loomframe.llm import op7_pii
from loomframe.llm.common import documents

NAMES = ["_w", "_l", "_q", "_gone", "_leaked", "_doc", "row", "d", "k", "q", "gone", "left", "node", "key"]


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(10_000)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows(spark):
    texts = [
        (1, prose(1)), (2, prose(1)), (2, prose(2)), (2, prose(2)), (None, prose(3)), (None, prose(3)), (None, None), (3, None), (4, ""), (5, " \n \t"),
        (6, "\n".join(prose(k, 20) for k in range(100, 400))), (7, "x" * 1_000_000 + "."), (8, "tie " * 12 + "."), (9, prose(4) + "\n" + prose(5)), (10, prose(6) + "\n" + prose(5)),
    ]
    table = [(i, x, "en", "s", len(x or ""), *([k] * len(NAMES))) for k, (i, x) in enumerate(texts)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES)).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, rows, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, rows, sf_dir)
    left = out.collect()
    empty = stage(spark, rows.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0
    if name == "byte-level BPE":
        assert len(left) == 15
        return
    assert out.columns == rows.columns
    kept = {r._w for r in left}
    assert all(r[c] == r._w for r in left for c in NAMES) and {0, 10, 13} <= kept
    if name == "near-dedup":
        assert 1 not in kept and {2, 3, 6, 7, 8, 9} <= kept and len(kept & {4, 5}) == 1
    if name == "line dedup":
        assert {r._w: r.text for r in left}[14] == prose(6) and all(r.n_chars == len(r.text or "") for r in left)
    if name == "decontamination":
        assert len(left) == 15


def test_personal_data_of_awkward_rows(spark, rows):
    found = op7_pii.personal_data(rows).collect()
    assert len(found) == 15 and all(r.found == [] for r in found)
    assert op7_pii.personal_data(rows.limit(0)).count() == 0


def test_run_leaves_one_table(spark, sf_dir):
    from loomframe.llm.common import tables

    before = tables()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.count() <= documents(spark, sf_dir).count() and len(tables()) == len(before) + 1

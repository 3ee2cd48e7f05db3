"""The stages on documents without an id: a row goes for its own text, never for that of another."""

import random

from loomframe.llm import op2_lines, op4_decontaminate, op9_minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, x, "en", "src0", len(x or "")) for i, x in rows], SCHEMA).repartition(3)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_without_ids(spark, sf_dir):
    a, near = prose(1), prose(1) + " end"
    rows = [(None, a), (None, a), (None, near), (None, prose(2)), (None, None), (None, ""), (1, prose(3)), (None, prose(3)), (2, prose(3))]
    docs = table(spark, rows)
    left = texts(op9_minhash.stage(spark, docs, sf_dir))
    of_a = [x for x in left if x[1] in (a, near)]
    assert len(of_a) == 1
    assert [x for x in left if x not in of_a] == sorted([(None, prose(2)), (None, None), (None, ""), (1, prose(3))], key=repr)
    assert sum(r.kept for r in op9_minhash.near_duplicates(docs).collect()) == 5


def test_decontamination_without_ids(spark, tmp_path):
    item = prose(4, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(5) + " " + item), (None, prose(6)), (7, prose(8)), (7, item), (None, None)]
    left = texts(op4_decontaminate.stage(spark, table(spark, rows), str(tmp_path)))
    assert left == sorted([(None, prose(6)), (7, prose(8)), (None, None)], key=repr)


def test_lines_without_ids(spark, sf_dir):
    shared, own = prose(9, 12), prose(10, 12)
    rows = [(None, f"{prose(11, 12)}\n{shared}"), (None, f"{own}\n{prose(12, 12)}"), (3, f"{prose(13, 12)}\n{shared}"), (None, f"{prose(14, 12)}\n{shared}")]
    left = [x for _, x in texts(op2_lines.stage(spark, table(spark, rows), sf_dir))]
    assert sum(x.split("\n").count(shared) for x in left) == 1 and sum(len(x.split("\n")) for x in left) == 6

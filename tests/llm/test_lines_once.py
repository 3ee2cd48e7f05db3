"""Line dedup makes normal forms and shingle sets once, and the sets by generated code."""

import random
import re

from pyspark.sql import functions as F

from loomframe.llm import op2_lines


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_normal_forms_are_made_once(spark):
    texts = ["  One Line \n\n \t \nÉTÉ\r\n\x0b\x0cx", None, "", " ", "\n\n", "a\n b\nA"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    lines = op2_lines.lines_of(docs)
    assert len(re.findall(r"\blower\(", plan(lines))) == 1
    found = {(r.doc_id, r.line_no): r.line for r in lines.collect()}
    blanks = " \t\n\x0b\x0c\r"
    want = {(i, k): x.strip(blanks).lower() for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip(blanks)}
    assert found == want


def test_links_against_brute_force(spark):
    rng = random.Random(11)
    base = [rng.choice("abcdefghé一😀") for _ in range(90)]
    lines = ["", "x", "xy", "short", "ab" * 40, "ab" * 41, "a" * 7, "a" * 8, "a" * 200]
    for k in range(40):
        x = list(base)[: rng.randint(20, 90)] if k % 3 else list(base)
        for at in rng.sample(range(len(x)), k % 4):
            x[at] = "#"
        lines.append("".join(x))
    rows = [(a, b, lines[a], lines[b]) for a in range(len(lines)) for b in range(a)]
    links = op2_lines.links_of(spark.createDataFrame(rows, "a long, b long, la string, lb string").repartition(3), 80)
    assert plan(links).count("array_distinct(") == 2
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in lines]
    want = {(a, b) for a, b, *_ in rows if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in links.collect()} == want and len(want) > 5


def test_shingle_sets_are_not_made_in_a_lambda(spark):
    sets = spark.createDataFrame([("abcdefghabcdefgh",)], "line string").repartition(1).select(op2_lines.shingle_set(F.col("line")).alias("x"))
    assert plan(sets).index("array_distinct(") < plan(sets).index("lambdafunction(") and len(sets.first().x) == 8

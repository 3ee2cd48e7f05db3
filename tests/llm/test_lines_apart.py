"""Line dedup on many near copies that are just too far from each other: they are told apart by sketches."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import op2_lines


def altered(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"{rng.randrange(10**7):07d}"
    return out


def shingles(x, n=8):
    return {x[k : k + n] for k in range(max(1, len(x) - n + 1))}


def test_sketches_let_every_link_through(spark):
    rng = random.Random(4)
    base = [f"{rng.randrange(10**7):07d}" for _ in range(60)]
    lines = [" ".join(altered(rng, base[: rng.randint(5, 60)], k % 5)) for k in range(120)] + ["ab" * 40, "ab" * 41, "x", "xy", "é😀" * 30]
    sketches = op2_lines.parities(spark.createDataFrame(list(enumerate(lines)), "node long, line string"))
    assert {r.node: r.n for r in sketches.collect()} == {k: len(shingles(x)) for k, x in enumerate(lines)}
    x, y = (sketches.select(*[F.col(c).alias(p + c) for c in sketches.columns]) for p in "xy")
    through = {tuple(r) for r in x.join(y, F.col("xnode") < F.col("ynode")).where(op2_lines.may_link("x", "y", 80)).select("xnode", "ynode").collect()}
    sets = [shingles(x) for x in lines]
    similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(lines)) for a in range(b)}
    assert {p for p, j in similar.items() if j >= 0.8} <= through and not any(similar[p] < 0.7 for p in through)


@pytest.mark.parametrize("block", [64, 2048])
def test_many_lines_apart(spark, monkeypatch, block):
    """2,000 lines of which some two million pairs share a band and only a few are links."""
    rng = random.Random(6)
    base = [f"{rng.randrange(10**7):07d}" for _ in range(60)]
    lines = [" ".join(altered(rng, base, 9)) for _ in range(2000)]
    lines += [x[:-1] + "#" for x in lines[::100]]
    monkeypatch.setattr(op2_lines, "BLOCK", block)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    began = time.time()
    found = {r.doc_id: r.first_doc_id for r in op2_lines.line_groups(rows).collect()}
    assert all(found[2000 + k] == found[100 * k] for k in range(20))
    assert time.time() - began < 40  # 72 s when sets were compared for every pair, 10 s with sketches


def test_stage_of_the_pipeline_on_many_lines_apart(spark, sf_dir):
    rng = random.Random(7)
    base = [f"{rng.randrange(10**7):07d}" for _ in range(60)]
    lines = [" ".join(altered(rng, base, 9)) for _ in range(2000)]
    lines += [x[:-1] + "#" for x in lines[::100]]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    began = time.time()
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, rows, sf_dir).collect()}
    assert not left & set(range(2000, 2020)) and set(range(0, 2000, 100)) & left
    assert time.time() - began < 40

"""Line dedup on lines that words don't cut up."""

import random

from loomframe.llm import op2_lines

SCHEMA = "doc_id long, text string"


def grouped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2)
    return {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in op2_lines.line_groups(docs).collect()}


def test_lines_are_compared_by_all_characters(spark):
    rng = random.Random(8)
    unspaced = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(90))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(60))
    words = " ".join(f"{rng.randrange(10**11):011d}" for _ in range(6))
    other_ends = " ".join(w[:8] + f"{rng.randrange(1000):03d}" for w in words.split())
    texts = [
        "https://example.org/archive/2020/alpha/report-one.html",
        "https://example.org/shop/cart/item/99812",
        unspaced,
        "#" + unspaced[1:],
        chinese,
        "一" + chinese[1:],
        words,
        other_ends,
    ]
    assert grouped(spark, texts) == {(2, 0): (2, 0), (3, 0): (2, 0), (4, 0): (4, 0), (5, 0): (4, 0)}


def test_short_lines_count(spark):
    texts = ["All rights reserved.\n}\n \n\ntwelve chars", "all rights reserved. \n}\n\n", "next\nto all rights reserved", "next\ntwelve charsX"]
    assert grouped(spark, texts) == {
        (0, 0): (0, 0),
        (1, 0): (0, 0),
        (0, 1): (0, 1),
        (1, 1): (0, 1),
        (2, 0): (2, 0),
        (3, 0): (2, 0),
        (0, 4): (0, 4),
        (3, 1): (0, 4),
    }

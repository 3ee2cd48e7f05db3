"""Line dedup makes the set of a node that comes in many pairs once for them, not once for each."""

import random

from loomframe.llm import op2_lines


def shingles(x, n=8):
    return {x[k : k + n] for k in range(max(1, len(x) - n + 1))}


def test_links_among_few_nodes_against_brute_force(spark):
    rng = random.Random(12)
    base = [rng.choice("abcdefghé一😀") for _ in range(120)]
    lines = ["x", "xy", "ab" * 40, "ab" * 41, "a" * 7, "a" * 200]
    for k in range(40):
        x = list(base)
        for at in rng.sample(range(len(x)), k % 5):
            x[at] = "#"
        lines.append("".join(x))
    rows = [(a, b) for a in range(len(lines)) for b in range(a)]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string").repartition(3)
    pairs = spark.createDataFrame(rows, "a long, b long").repartition(3)
    found = {tuple(r) for r in op2_lines.links_among(pairs, texts, 80).collect()}
    sets = [shingles(x) for x in lines]
    assert found == {(a, b) for a, b in rows if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])} and len(found) > 50


def test_strays_have_their_sets_made_once_for_all_pairs(spark, monkeypatch):
    """Near copies just too far from each other: their pairs aren't given two texts each, of which both would be made sets."""
    rng = random.Random(6)
    base = [f"{rng.randrange(10**7):07d}" for _ in range(60)]
    lines = []
    for _ in range(200):
        words = list(base)
        for k in rng.sample(range(60), 5):
            words[k] = f"{rng.randrange(10**7):07d}"
        lines.append(" ".join(words))
    lines += [x[:-1] + "#" for x in lines[::10]]
    compared, before = [], op2_lines.links_of

    def links_of(pairs, percent):
        compared.append(pairs.count())
        return before(pairs, percent)

    monkeypatch.setattr(op2_lines, "links_of", links_of)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.first_doc_id for r in op2_lines.line_groups(rows).collect()}
    assert all(found[200 + k] == found[10 * k] for k in range(20))
    assert len(compared) == 1 and compared[0] < 220 * 10  # one pair for a node of a band

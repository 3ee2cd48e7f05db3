"""Substring dedup where one passage comes with very many contexts: its segments go by window hashes."""

import random

import pyarrow as pa

from loomframe.llm import op10_suffix


def test_windows_of_many_segments_come_at_once():
    rng = random.Random(3)
    segments = [bytes(rng.choices(b"abcdef", k=rng.randint(200, 260))) for _ in range(1500)]
    segments[7] = segments[1300]
    columns = [pa.array(range(1500), pa.int64()), pa.array([5] * 1500, pa.int64()), pa.array([k % 3 > 0 for k in range(1500)]), pa.array(segments, pa.binary())]
    found = list(op10_suffix._windows(iter([pa.RecordBatch.from_arrays(columns, names=["doc", "start", "open", "bytes"])])))
    assert len(found) <= 2  # 1,500 batches of one segment each before
    table = pa.Table.from_batches(found)
    want = [(k, 5 + i, k % 3 > 0, x[i : i + 200]) for k, x in enumerate(segments) for i in range(len(x) - 199)]
    assert list(zip(*(table[c].to_pylist() for c in ("doc", "at", "open")))) == [x[:3] for x in want]
    hashes = list(zip(table["w1"].to_pylist(), table["w2"].to_pylist()))
    assert len(dict(zip(hashes, [x[3] for x in want]))) == len(set(hashes)) == len({x[3] for x in want})


def test_pieces_of_many_texts_come_at_once():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé", k=900)) for _ in range(300)]
    wanted = [[{"anchor": k * 10 + i, "start": 100 * i, "more": i, "open": i > 1} for i in range(4)] for k in range(300)]
    kind = pa.list_(pa.struct({"anchor": pa.int64(), "start": pa.int64(), "more": pa.int32(), "open": pa.bool_()}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array(wanted, kind)], names=["doc", "text", "wanted"])
    found = list(op10_suffix._cut(iter([batch.slice(1, 200), batch.slice(201)])))
    assert len(found) <= 2  # one for each text before
    rows = [tuple(r.values()) for r in pa.Table.from_batches(found).to_pylist()]
    assert rows == [(w["anchor"], k, w["start"], w["open"], texts[k].encode()[w["start"] : w["start"] + w["more"] + 200]) for k in range(1, 300) for w in wanted[k]]


def test_hot_anchors_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = prose(45)
    texts = [f"{prose(60)} {common} {prose(60)}" for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cold = sorted(tuple(r) for r in op10_suffix.repeated_bytes(rows).collect())
    monkeypatch.setattr(op10_suffix, "HOT", 20)
    hot = sorted(tuple(r) for r in op10_suffix.repeated_bytes(rows).collect())
    assert hot == cold and all(r[2] >= len(common) and r[3] == 1 for r in hot)

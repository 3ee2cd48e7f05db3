"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of enhanced suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import discard, documents, materialize, release, ship

LENGTH = 200
#: Windows of LENGTH bytes meet by their anchor: of their grams of so many bytes the one of least hash, the leftmost of equals.
GRAM = 32
#: Bytes of a suffix array; segments of one anchor stay together. An anchor with more distinct segments goes by window hashes.
BLOCK, HOT = 1_000_000, 4096
_TABLES = [np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64) for seed in (101, 202)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POS = np.uint64((1 << 20) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every window of so many bytes, by doubling: joined from hashes of windows of powers of two."""
    h, size, out, done, base = _TABLES[which][data], 1, None, 0, _BASES[which]
    n = len(data) - length + 1
    while True:
        if length & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if done == length:
            return mix(out)
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2


def segments(data: np.ndarray, length: int = LENGTH, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the maximal runs of windows that have the same anchor.

    Equal windows have equal anchors at the same place in them, wherever they are: what repeats meets by its anchor.
    """
    n = len(data) - length + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, n, block):
        part = data[lo : lo + block + length - 1]
        grams = window_hashes(part, GRAM)
        packed = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        width, at = length - GRAM + 1, 1
        while at * 2 <= width:
            packed = np.minimum(packed[:-at], packed[at:])
            at *= 2
        if width > at:
            packed = np.minimum(packed[: len(packed) - width + at], packed[width - at :])
        cut = np.flatnonzero(packed[1:] != packed[:-1]) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(packed)]]) - 1
        found.append((grams[(packed[first] & _POS).astype(np.intp)], first + lo, last + lo))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of all suffixes by their first ``depth`` codes or more, equal ones in any order, and the ranks by the first 7, 14, 28 ... codes.

    Prefix doubling: the rank by 2k codes is the rank of the pair of ranks by k codes. Codes are below 512.
    """
    n, size = len(codes), 7
    padded = np.concatenate([codes, np.zeros(size, codes.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(size):
        key = (key << 9) | padded[k : k + n]
    levels = []
    while True:
        order = np.argsort(key)
        by = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])]) + 1
        levels.append((size, rank))
        if size >= depth or rank.max() == n:
            return order, levels
        key = rank * (n + 2)
        key[: max(0, n - size)] += rank[size:]
        size *= 2


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    """For each of the sorted suffixes the length of the prefix that it shares with the one before (0 for the first)."""
    n = len(codes)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)

    def same(values: np.ndarray) -> np.ndarray:
        ok = (a < n) & (b < n)
        ok[ok] = values[a[ok]] == values[b[ok]]
        return ok

    for size, rank in reversed(levels):
        step = same(rank) * size
        a, b, out = a + step, b + step, out + step
    going = np.ones(len(out), bool)
    for _ in range(levels[0][0] - 1):
        going &= same(codes)
        a, b, out = a + going, b + going, out + going
    return np.concatenate([[0], out])


def maximal_repeats(parts: list[bytes], length: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(length, starts) of all groups of maximal repeats of at least so many bytes; starts count in the parts joined by one separator each.

    The sorted suffixes with their common prefixes are scanned with a stack: what is opened by a longer prefix and closed
    by a shorter one is an interval, a string with all its occurrences. It can't be longer to the right; it is a maximal
    repeat if it can't to the left either: if its occurrences come after different bytes, or one starts a part.
    """
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1  # of each part: where its separator is
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    codes = raw.astype(np.int16) + 1
    codes[ends] = 0
    left = np.concatenate([[0], codes[:-1]])  # 0: a part starts here
    room = np.repeat(ends, sizes + 1) - np.arange(len(codes))
    order, levels = suffix_array(codes, int(sizes.max(initial=0)))
    shared = common_prefixes(order, levels, codes)
    long = room[order] >= length
    # the least common prefix over suffixes that are left out counts too
    keep = np.flatnonzero(long)
    if len(keep) < 2:
        return []
    shared = np.minimum.reduceat(np.concatenate([shared, [0]]), np.concatenate([keep[:-1] + 1, [keep[-1] + 1]]))[:-1]
    order = order[keep]
    shared = np.concatenate([[0], np.minimum(shared, np.minimum(room[order[:-1]], room[order[1:]]))])
    first = np.flatnonzero(shared < length)
    last = np.concatenate([first[1:], [len(order)]])
    before = left[order]
    lo, hi = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    found = []
    for s, e in zip(*(x[(last - first > 1) & ((lo != hi) | (lo == 0))] for x in (first, last)), strict=True):
        found += _intervals(order[s:e], shared[s:e].tolist(), before[s:e].tolist(), length)
    return found


def _intervals(order: np.ndarray, shared: list[int], before: list[int], length: int) -> list[tuple[int, np.ndarray]]:
    """The stack scan over one run of suffixes that share ``length`` bytes."""
    found = []
    stack: list[list[int]] = []  # common prefix, first suffix, the byte before all so far (0: several)
    for i in range(1, len(order) + 1):
        now = shared[i] if i < len(order) else 0
        start, byte = i - 1, before[i - 1]
        while stack and stack[-1][0] > now:
            prefix, start, kept = stack.pop()
            byte = kept if kept == byte else 0
            if byte == 0:
                found.append((prefix, order[start:i]))
        if now >= length:
            if stack and stack[-1][0] == now:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else 0
            else:
                stack.append([now, start, byte])
    return found


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, whether the window that starts at each of its bytes is elsewhere too, from the maximal repeats."""
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(parts)
    change = np.zeros(total + 1, np.int64)
    for prefix, starts in maximal_repeats(parts, length):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + prefix - length + 1, -1)
    marked = np.cumsum(change)[:-1] > 0
    return [marked[b : b + n] for b, n in zip(begins, sizes, strict=True)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, segment (hashes), doc, start and more (windows after the first); one row set for each text of a batch."""
    hashed = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows: list[list[np.ndarray]] = [[], [], [], [], []]
        texts = dict(zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for doc, value in texts.items():
            text = value.as_py().encode()
            if len(text) < LENGTH:
                continue
            anchor, first, last = segments(np.frombuffer(text, np.uint8))
            rows[0].append(anchor)
            rows[1].append(np.fromiter((hashed(text[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)))
            rows[2].append(np.full(len(first), doc, np.int64))
            rows[3].append(first)
            rows[4].append(last - first)
        if rows[0]:
            a, s, d, f, m = (np.concatenate(x) for x in rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(d), pa.array(f.astype(np.int64)), pa.array(m.astype(np.int32))],
                names=["anchor", "segment", "doc", "start", "more"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text, in batches of some BLOCK bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def out(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["anchor", "doc", "start", "open", "bytes"])

    for batch in batches:
        rows, size = [[], [], [], [], []], 0
        listed = batch.column(2).flatten()
        fields = iter(zip(*(listed.field(k).to_pylist() for k in ("anchor", "start", "more", "open")), strict=True))
        for doc, value, n in zip(batch.column(0).to_pylist(), batch.column(1), pc.list_value_length(batch.column(2)).to_pylist(), strict=True):
            text = value.as_py().encode()
            for anchor, start, more, open_ in islice(fields, n):
                for row, x in zip(rows, (anchor, doc, start, open_, text[start : start + more + LENGTH]), strict=True):
                    row.append(x)
                size += more + LENGTH
                if size >= BLOCK:
                    yield out(rows)
                    rows, size = [[], [], [], [], []], 0
        if size:
            yield out(rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (doc, first, last) of repeated windows of the open segments; the rows come sorted by anchor, doc and start."""
    held: list[tuple[int, int, bool, bytes]] = []
    size, last, before = 0, None, None
    for batch in batches:
        for anchor, doc, start, open_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (anchor, doc, start) == before:  # of a copy of the text
                continue
            if anchor != last and size >= BLOCK:
                yield _ranges(held)
                held, size = [], 0
            held.append((doc, start, open_, data))
            size += len(data)
            last, before = anchor, (anchor, doc, start)
    if held:
        yield _ranges(held)


def _ranges(held: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    # of windows that aren't alone by their hash the segments are compared; the others can't repeat
    whole = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
    sizes = np.array([len(x[3]) for x in held])
    begins = np.cumsum(sizes) - sizes
    hashes = window_hashes(whole, LENGTH)
    inside = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begins, sizes, strict=True)])
    own = hashes[inside]
    order = np.argsort(own)
    by = own[order]
    twin = np.zeros(len(by), bool)
    twin[1:] = by[1:] == by[:-1]
    twin[:-1] |= twin[1:]
    some = np.zeros(len(whole) + 1, np.int64)
    some[inside[order[twin]]] = 1
    counts = np.add.reduceat(some[:-1], begins)
    rows: list[list[int]] = [[], [], []]
    chosen, parts = [], []
    for k in np.flatnonzero(counts):
        doc, start, open_, data = held[k]
        at = np.flatnonzero(some[begins[k] : begins[k] + sizes[k]])
        chosen.append((doc, start + int(at[0]), open_))
        parts.append(data[at[0] : at[-1] + LENGTH])
    if parts:
        for (doc, start, open_), marked in zip(chosen, repeated_windows(parts), strict=True):
            if open_:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
                rows[0] += [doc] * (len(edge) // 2)
                rows[1] += (edge[::2] + start).tolist()
                rows[2] += (edge[1::2] + start - 1).tolist()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc", "first", "last"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit hashes of every window of the segments, which are short: those of many segments are made at once."""
    for whole in batches:
        for lo in range(0, whole.num_rows, HOT):
            doc, start, open_, data = whole.slice(lo, HOT).columns
            raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
            sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
            n = sizes - LENGTH + 1
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # of a segment's windows
            inside = np.repeat(np.cumsum(sizes) - sizes, n) + nth
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(window_hashes(raw, LENGTH, k)[inside].view(np.int64)) for k in (0, 1)],
                    pa.array(np.repeat(doc.to_numpy(), n)),
                    pa.array(np.repeat(start.to_numpy(), n) + nth),
                    pa.array(np.repeat(open_.to_numpy(zero_copy_only=False), n)),
                ],
                names=["w1", "w2", "doc", "at", "open"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for value, copied, ranges in zip(*batch.columns[1:], strict=True):
            text = (value.as_py() or "").encode()
            spans: list[list[int]] = [[0, len(text)]] if copied.as_py() and len(text) >= LENGTH else []
            if not spans:
                for first, last in sorted((r["first"], r["last"]) for r in ranges.as_py() or ()):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + LENGTH)
                    else:
                        spans.append([first, last + LENGTH])
            kept, at = sha256(), 0
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            for row, x in zip(rows, (len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest()), strict=True):
                row.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(doc, first, last): runs of windows of LENGTH bytes that start anywhere else too, in texts (doc, text).

    1. Every text is cut into segments, runs of windows with the same anchor; 1 for each 70 bytes or so. 2. Where an
    anchor comes once, nothing repeats; where all segments of an anchor are equal, and where a segment comes twice, all
    their windows do. 3. What is left, mostly the edges of repeats, is compared with one segment of each kind of its
    anchor, in suffix arrays over blocks of whole anchors. Anchors with more than HOT kinds of segments, which no single
    task should hold, have their windows counted by hash instead.
    """
    spark = texts.sparkSession
    rows = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_segments, "anchor long, segment long, doc long, start long, more int")
    anchors = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("lo"), F.max("segment").alias("hi")).where("n > 1")
    anchors = materialize(anchors.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    shared = materialize(rows.join(anchors, "anchor"), "shared")
    discard(anchors)
    release(spark)
    one = F.min(F.struct("doc", "start", "more")).alias("r")
    kinds = shared.where("mixed").groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), one)
    kinds = materialize(kinds.select("anchor", "segment", (F.col("n") == 1).alias("open"), "r.doc", "r.start", "r.more"), "kinds")
    whole = shared.where("not mixed").select("doc", F.col("start").alias("first"), (F.col("start") + F.col("more")).alias("last")).unionByName(
        shared.where("mixed").join(kinds.where("not open").select("anchor", "segment"), ["anchor", "segment"]).select("doc", F.col("start").alias("first"), (F.col("start") + F.col("more")).alias("last"))
    )
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("open").alias("any")).where("any")
    wanted = kinds.join(per, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "more", "open")).alias("wanted"))
    pieces = texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_cut, "anchor long, doc long, start long, open boolean, bytes binary")
    pieces = materialize(pieces, "pieces")
    hot = per.where(F.col("kinds") > HOT).select("anchor")
    hot = materialize(hot, "hot")
    cold = pieces.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    edges = materialize(cold.mapInArrow(_blocks, "doc long, first long, last long"), "edges")
    found = whole.unionByName(edges)
    if not hot.isEmpty():
        windows = pieces.join(hot, "anchor", "left_semi").select("doc", "start", "open", "bytes").mapInArrow(_windows, "w1 long, w2 long, doc long, at long, open boolean")
        place = F.struct("doc", "at")
        twice = windows.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("w1", "w2")
        again = windows.where("open").join(twice, ["w1", "w2"], "left_semi").select("doc", F.col("at").alias("first"), F.col("at").alias("last"))
        found = found.unionByName(again.distinct())
    out = materialize(found, "ranges")
    for table in (shared, kinds, pieces, hot, edges):
        discard(table)
    release(spark)
    return out


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row: bytes covered by a string of LENGTH bytes that
    also starts anywhere else.

    Rows of the same text (by a 64-bit hash) are searched once; all their windows repeat. Null and empty texts, and
    those under LENGTH bytes, keep all. Repeated rows, null ids and ties are rows as any other, as only texts are
    compared; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.xxhash64("text").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = repeated_ranges(texts)
    listed = ranges.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    copies = texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("copied"))
    marks = materialize(copies.join(listed, "doc", "full").select("doc", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied").isNull(), F.col("ranges")).alias("ranges")), "marks")
    discard(ranges)
    release(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc"), "text").join(marks, "doc", "left").select("doc_id", "text", "copied", "ranges")
    return rows.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of every document."""
    return repeated_bytes(documents(spark, sf_dir))


QUERIES = {"op10_suffix": op10_suffix}
SQL: dict[str, str] = {}

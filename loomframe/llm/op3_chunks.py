"""Substring dedup by content-defined chunking: a gear rolling hash cuts, digests of the variable chunks meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import discard, documents, materialize, release, ship

#: Bytes of a chunk: at least, on average beyond that, at most.
LEAST, AVERAGE, MOST = 24, 32, 512
#: Repeated chunks count when, next to each other, they have so many bytes; a passage of 50 words has some 300.
LEAST_RUN = 96
_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 11) & 0xFFFFFFFF for b in range(256)], np.uint32)
#: The cut looks at the top bits, which depend on the last 32 bytes.
_MASK = np.uint32((AVERAGE - 1) << (32 - (AVERAGE - 1).bit_length()))


def gear(data: np.ndarray) -> np.ndarray:
    """h = 2 h + G[byte] in 32 bits at every position, by doubling: after five steps each value has its last 32 bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text. A cut depends on the 32 bytes before it, so after an insertion the old cuts return."""
    n = len(text)
    if not n:
        return []
    at = np.flatnonzero((gear(np.frombuffer(text, np.uint8)) & _MASK) == 0) + 1
    out, last = [], 0
    for p in at.tolist():
        if p - last >= LEAST:
            while p - last > MOST:
                last += MOST
                out.append(last)
            if p - last >= LEAST:
                out.append(p)
                last = p
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest (two halves), doc (hash of the text), start and size of every chunk; one row for each text of a batch."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        texts = {t for v in batch.column(0) if (t := v.as_py())}
        rows: list[list] = [[], [], [], []]
        for n, text in enumerate(sorted(texts), 1):
            data = text.encode()
            key, start = xxhash.xxh3_64_intdigest(data), 0
            for end in cuts(data):
                rows[0].append(digest(data[start:end]))
                rows[1].append(key)
                rows[2].append(start)
                rows[3].append(end - start)
                start = end
            if n == len(texts) or len(rows[0]) > 200_000:
                halves = np.frombuffer(b"".join(rows[0]), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        pa.array(np.array(rows[1], np.uint64).view(np.int64)),
                        pa.array(rows[2], pa.int64()),
                        pa.array(rows[3], pa.int32()),
                    ],
                    names=["d1", "d2", "doc", "start", "size"],
                )
                rows = [[], [], [], []]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [(v.as_py() or "").encode() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in data], np.uint64).view(np.int64))],
            names=["doc_id", "n_bytes", "doc"],
        )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc (64-bit hash of a text), start, size and first (whether it is the digest's first chunk) of the chunks whose digest
    comes twice or more in the distinct texts. First: least doc, then least start.

    Only digests are counted in the first shuffle, with partial sums; only the chunks of repeated ones leave the second.
    """
    rows = docs.select("text").mapInArrow(_chunks, "d1 long, d2 long, doc long, start long, size int")
    twice = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start")).alias("f")).where("n > 1").select("d1", "d2", "f")
    twice = materialize(twice, "digests")
    # copies of a text in other batches give equal rows: one of each stays
    out = rows.join(twice, ["d1", "d2"]).select("doc", "start", "size", "d1", F.col("f.doc").alias("fd"), F.col("f.start").alias("fs")).distinct()
    out = materialize(out, "repeated")
    discard(twice)
    release(docs.sparkSession)
    once = out.groupBy("d1", "fd", "fs").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("d1", "fd", "fs")  # a digest only of copies of one text
    return out.join(once, ["d1", "fd", "fs"], "left_anti").select("doc", "start", "size", ((F.col("doc") == F.col("fd")) & (F.col("start") == F.col("fs"))).alias("first"))


def _runs(chunks, wanted):
    """Joined (start, end) of neighbouring repeated chunks with LEAST_RUN bytes, and of those the parts that aren't first."""
    runs, removed = [], []
    for start, size, first in sorted(chunks):
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + size
            runs[-1][2].append((start, size, first))
        else:
            runs.append([start, start + size, [(start, size, first)]])
    runs = [r for r in runs if r[1] - r[0] >= wanted]
    for _, _, parts in runs:
        for start, size, first in parts:
            if first:
                continue
            if removed and removed[-1][1] == start:
                removed[-1][1] = start + size
            else:
                removed.append([start, start + size])
    return [r[:2] for r in runs], removed


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: list[list] = [[], [], [], []]
        for doc, chunks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            runs, removed = _runs([(c["start"], c["size"], c["first"]) for c in chunks], LEAST_RUN)
            if runs:
                kept[0].append(doc.as_py())
                kept[1].append(sum(e - s for s, e in runs))
                kept[2].append(sum(e - s for s, e in removed))
                kept[3].append([{"start": s, "end": e} for s, e in removed])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(kept, kinds, strict=True)], names=["doc", "n_repeated", "n_removed", "spans"])


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_repeated, n_removed, copy_of and spans for every row.

    n_repeated: UTF-8 bytes in runs of repeated chunks of LEAST_RUN bytes and more. n_removed and spans (byte start, end):
    those of them that aren't the first of their digest, which are the ones to remove. Whole copies of a text count as
    one text here: copy_of is the least doc_id of the rows of the same text, n_repeated is n_bytes for all of them, and
    only the row of copy_of keeps what the text keeps; the others lose all (n_removed is n_bytes, spans the whole text).

    Null and empty texts have no chunks. A repeated row is a copy as any other, but rows of the same least doc_id are
    alike. Null ids come after all others in copy_of. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_keys, f"doc_id {kind}, n_bytes long, doc long"), "rows")
    chunks = repeated_chunks(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "size", "first")).alias("chunks"))
    found = chunks.mapInArrow(_summary, "doc long, n_repeated long, n_removed long, spans array<struct<start:long,end:long>>")
    copies = rows.groupBy("doc").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_rows"))
    out = rows.join(copies, "doc").join(found, "doc", "left")
    copied = (F.col("n_bytes") > 0) & ~F.col("doc_id").eqNullSafe(F.col("copy_of"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("n_rows") > 1, F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).alias("n_repeated"),
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        "copy_of",
        F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
    )


def cut_out(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the bytes of the spans; characters that a span cuts through go."""
    if not text or not spans:
        return text
    data, at, out = text.encode(), 0, []
    for start, end in sorted(spans):
        out.append(data[at:start])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode(errors="ignore")


def op3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated substrings of every document."""
    return repeated_substrings(documents(spark, sf_dir)).withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ","))


QUERIES = {"op3_chunks": op3_chunks}
SQL: dict[str, str] = {}

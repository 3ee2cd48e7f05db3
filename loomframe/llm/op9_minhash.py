"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets and grouping by union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import BLANKS, LANES, WORDS as SKETCH_WORDS, banded_components, discard, documents, equal_lanes, least_lanes, materialize, nodes_of, release, ship

WORDS = 5
#: 16 bands of 4 slots: a pair of similarity 0.85 shares none with a chance of 7 in a million.
BANDS, ROWS = 16, 4
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LOW = np.uint64(0xFFFFFFFF)


def times(k: int) -> np.uint64:
    """k steps of the golden ratio's sequence."""
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> tuple[np.ndarray, int]:
    """Sorted distinct 64-bit hashes of the n-word shingles, and a 128-bit hash of the whole word sequence.

    A-Z are lower-cased. Fewer than n words are one shingle; without words the set is empty and the hash 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64), 0
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    whole = xxhash.xxh3_128_intdigest(hashed.tobytes(), len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(hashed.tobytes(), 1)], np.uint64), whole
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(5) + hashed[k : len(words) - n + 1 + k] + times(k + 1))
    return np.unique(out), whole


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, m: int = BANDS * ROWS, block: int = 400_000) -> np.ndarray:
    """SuperMinHash signatures (sets x m) of many sets at once; element i is in the set owner[i].

    Every element goes through the slots in an order of its own, a random permutation, and leaves j plus a random
    fraction in the j-th: the slots keep the least value. So an element never has the same rank twice, which lowers the
    variance against independent hashes. A set is done when every slot has a value under j, as later ones are larger;
    mostly after two or three of m steps. Values are j * 2^32 + fraction, empty sets have the largest value throughout.
    """
    out = np.full(sets * m, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(elements), block):
        x, at = elements[lo : lo + block], owner[lo : lo + block]
        order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), m)).copy()
        for j in range(m):
            r = mix(x + times(j + 1))
            k = (j + (((r >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.intp)
            rows = np.arange(len(x))
            slot = order[rows, k]
            order[rows, k] = order[:, j]
            order[:, j] = slot
            np.minimum.at(out, at * m + slot, (np.uint64(j) << np.uint64(32)) | (r & _LOW))
            open_ = out.reshape(sets, m).max(axis=1) >= (np.uint64(j + 1) << np.uint64(32))
            alive = open_[at]
            if not alive.any():
                break
            if not alive.all():
                x, at, order = x[alive], at[alive], order[alive]
    return out.reshape(sets, m)


def bands(signatures: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(signatures), n_bands), np.uint64)
    part = signatures.reshape(len(signatures), n_bands, rows)
    for k in range(rows):
        out = mix(out * np.uint64(7) + part[:, :, k] + _MIX[0])
    return mix(out + np.arange(n_bands, dtype=np.uint64) * _MIX[2])


def sketches(signatures: np.ndarray) -> np.ndarray:
    """The lowest bytes of LANES slots in words of seven, for ``equal_lanes``."""
    lanes = (signatures[:, :LANES] & np.uint64(255)).reshape(len(signatures), SKETCH_WORDS, 7)
    return (lanes << (np.uint64(8) * np.arange(7, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, n_shingles, class (two halves of its hash), the band keys and the sketch of every row (none without words)."""
    for batch in batches:
        found = [shingles(v.as_py()) for v in batch.column(2)]
        keys: dict[int, np.ndarray] = {}
        lanes: dict[int, np.ndarray] = {}
        for some in _portions({whole: s for s, whole in found if len(s)}):
            owner = np.repeat(np.arange(len(some)), [len(s) for _, s in some])
            signatures = superminhash(np.concatenate([s for _, s in some]), owner, len(some))
            keys |= zip([c for c, _ in some], bands(signatures), strict=True)
            lanes |= zip([c for c, _ in some], sketches(signatures), strict=True)
        halves = [pa.array(np.array([whole >> k & 0xFFFFFFFFFFFFFFFF for _, whole in found], np.uint64).view(np.int64)) for k in (64, 0)]
        listed = [pa.array([of[whole].view(np.int64) if whole in of else [] for _, whole in found], pa.list_(pa.int64())) for of in (keys, lanes)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s, _ in found], pa.int64()), *halves, *listed],
            names=["doc_id", "text_key", "n_shingles", "c1", "c2", "keys", "sketch"],
        )


def _portions(found: dict[int, np.ndarray], most: int = 300_000) -> Iterator[list[tuple[int, np.ndarray]]]:
    some, n = [], 0
    for item in found.items():
        if some and n + len(item[1]) > most:
            yield some
            some, n = [], 0
        some.append(item)
        n += len(item[1])
    if some:
        yield some


def _verify(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = []
            for i in range(batch.num_rows):
                if a[i] != last:  # rows of an a often follow each other
                    last, x = a[i], shingles(ta[i].as_py())[0]
                y = shingles(tb[i].as_py())[0]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return work


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; see ``marked``."""
    return marked(docs, percent).drop("text_key")


def marked(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), n_shingles, component_id and kept for every row: components of the texts whose sets of five-word shingles
    have a Jaccard similarity of ``percent`` hundredths or more.

    Texts of the same words are one class from the start (by a 128-bit hash of the word sequence). Signatures find the
    classes to compare (missing a pair in about 100,000 at the threshold; see ``banded_components`` for which pairs of a
    band), full sets confirm the links.

    Null, empty and blank texts have no shingles and a component of their own: their doc_id, and kept is true. Repeated
    rows are in the component of their text. Where doc_id is null the row takes no part in the minimum; a component of
    nulls only has a null component_id and keeps one row, of the least text_key. Other columns are ignored; an empty table
    gives no rows. Very long texts are taken whole: a signature is made of 400,000 shingles at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("text").alias("text_key")
    signed = docs.select("doc_id", key, "text").mapInArrow(_signed, f"doc_id {kind}, text_key long, n_shingles long, c1 long, c2 long, keys array<long>, sketch array<long>")
    rows = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    one = rows.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min(F.struct("text_key", "doc_id", "n_shingles", "keys", "sketch")).alias("o"))
    one = materialize(one.select("c1", "c2", "o.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = one.select("node", "n_shingles")
    release(spark)
    texts: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        """Only pairs of sets of like sizes need their texts, which come from one row of each class and meet by pair.

        The first pairs have all nodes that later ones have.
        """
        if not texts:
            wanted = one.select("node", F.col("text_key").alias("k"), F.col("doc_id").alias("d")).join(nodes_of(pairs), "node", "left_semi")
            source = docs.select("doc_id", key, "text")
            found = source.join(wanted, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
            texts.append(materialize(found.dropDuplicates(["node"]), "texts"))
            release(spark)
        a, b = (sizes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}")) for c in "ab")
        likely = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
        likely = materialize(likely, "likely")
        left = likely.join(texts[0].select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        both = left.join(texts[0].select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        links = materialize(both.mapInArrow(_verify(percent), "a long, b long"), "links")
        discard(likely)
        return links

    def compare(rest: DataFrame) -> DataFrame:
        """The join of a key's nodes gives only pairs whose sketches are near enough for a link; these are verified on full sets."""
        words = range(SKETCH_WORDS)
        rows = materialize(rest.join(one.select("node", "n_shingles", "sketch"), "node"), "rest")
        x = rows.where("c <> main").select("key", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n_shingles").alias("nx"), *[F.col("sketch")[w].alias(f"x{w}") for w in words])
        y = rows.select(F.col("key").alias("k"), F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n_shingles").alias("ny"), *[F.col("sketch")[w].alias(f"y{w}") for w in words])
        near = (F.col("cx") != F.col("cy")) & F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)") & (equal_lanes("x", "y") >= least_lanes(percent))
        pairs = x.join(y, (F.col("key") == F.col("k")) & near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        pairs = materialize(pairs, "rest-pairs")
        links = verify(pairs)
        discard(rows)
        discard(pairs)
        return links

    groups = banded_components(one.select("node", F.explode("keys").alias("key")), verify, compare, "groups")
    named = one.select("c1", "c2", "node").join(groups, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("group"))
    least = materialize(rows.drop("keys", "sketch").join(named, ["c1", "c2"], "left").drop("c1", "c2"), "grouped")
    for table in (rows, one, groups, *texts):
        discard(table)
    place = F.struct("text_key", "row")
    nameless = F.min(F.when(F.col("doc_id").isNull(), place)).alias("nameless")
    smallest = materialize(least.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("smallest"), nameless), "smallest")
    release(spark)
    chosen = F.when(F.col("smallest").isNull(), place == F.col("nameless")).otherwise(F.col("doc_id") == F.col("smallest"))
    return least.join(smallest, "group", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce((F.col("n_shingles") == 0) | chosen, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Of each group of near-duplicates the rows of least doc_id.

    Rows go by doc_id and text. Null, empty and blank texts stay, and so do repeated rows of one doc_id. Of a group without
    any id one row stays: equal texts of it can't be told apart by these two, so that they are one row from the start, the
    least by all columns that have an order. Other columns may have any names; an empty table gives no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    words = F.btrim(F.coalesce("row.text", F.lit("")), F.lit(BLANKS)) != ""
    nameless = rows.where(F.col("row.doc_id").isNull() & words)
    ordered = F.struct(*[F.col("row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    one = nameless.groupBy(F.xxhash64("row.text").alias("k")).agg(F.min_by("row", ordered).alias("row")).select("row")
    rows = rows.where(F.col("row.doc_id").isNotNull() | ~words).unionByName(one)
    gone = marked(rows.select("row.doc_id", "row.text"), percent).where("not kept").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    left = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("k")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (similarity 0.8 or more) one document stays; see
    ``drop_near_duplicates`` for nulls, empty and very long texts, ties, repeated rows, empty tables and other columns."""
    return drop_near_duplicates(docs)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document, at 85 hundredths."""
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op9_minhash": op9_minhash}
SQL: dict[str, str] = {}

"""Benchmark decontamination by spaced seeds: windows that ignore some positions find overlaps despite substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import discard, documents, let, materialize

#: 1: the token counts, 0: any token. A substituted token leaves windows in which it is at a 0 or outside.
MASKS = ("110110111", "111010011", "101101101")
SPAN = len(MASKS[0])
#: An overlap counts with so many equal tokens, or with so many hundredths of the item's tokens on one diagonal; in the
#: best stretch of a diagonal a mismatch costs as much as so many matches.
LEAST_MATCHES, WHOLE_PERCENT, MISMATCH = 12, 80, 4
#: Items of fewer than LEAST_MATCHES tokens have masks of their own length, each without one of the tokens; from LONE
#: tokens down there is one mask with all of them. An item of fewer than LONE tokens must be the whole document.
LONE = 4
#: Benchmark windows are broadcast up to so many rows (16 bytes each and as much again for the hash table); beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def short_masks(n: int) -> list[str]:
    return ["1" * k + "0" + "1" * (n - k - 1) for k in range(n)] if n > LONE else ["1" * n]


def seeds(words: Column, lengths: tuple[int, ...] = (), own: bool = False) -> Column:
    """(at, seed) for every window and mask: where the window starts, and a 64-bit hash of the tokens that count.

    lengths: of the short items there are; windows of these lengths have their short masks besides. own: the words are
    an item's, whose short masks are those of its own length only.
    """
    none = F.array().cast("array<struct<at:int,seed:bigint>>")

    def windows(h: Column, n: int, masks, salt: int) -> Column:
        def at(i: Column) -> Column:
            hashed = [F.xxhash64(F.lit(salt + m), *[F.get(h, i + k) for k in range(n) if mask[k] == "1"]) for m, mask in enumerate(masks)]
            return F.array(*[F.struct(i.alias("at"), x.alias("seed")) for x in hashed])

        fits = F.size(h) == n if n < LONE or (own and n < LEAST_MATCHES and masks is not MASKS) else F.size(h) >= n
        return F.when(fits, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), at))).otherwise(none)

    def all_of(h: Column) -> Column:
        found = windows(h, SPAN, MASKS, 0)
        return F.concat(found, *[windows(h, n, short_masks(n), 100 * n) for n in lengths]) if lengths else found

    return let(F.transform(words, lambda x: F.xxhash64(x)), all_of)


def overlap(doc: Column, item: Column, shift: Column) -> Column:
    """The best overlap along a diagonal, where token k of the item is against token k + shift of the document.

    Best: largest sum of 1 for equal and -MISMATCH for other tokens, so that at least four fifths are equal; the first
    of several. As (n_match, back: -shift, item_start, n_tokens, n_equal: equal tokens of the whole diagonal). Where the
    whole diagonal has WHOLE_PERCENT of the item's tokens, it is the overlap.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(0).alias("best"), F.lit(0).alias("n_match"), F.lit(0).alias("item_start"), F.lit(0).alias("n_tokens"), F.lit(0).alias("n_equal"))

    def step(a: Column, k: Column) -> Column:
        same = F.coalesce(F.get(doc, k + shift) == F.get(item, k), F.lit(False))
        fresh = a["score"] <= 0
        score = F.greatest(a["score"], F.lit(0)) + F.when(same, 1).otherwise(-MISMATCH)
        new = F.struct(score.alias("s"), (F.when(fresh, 0).otherwise(a["n"]) + same.cast("int")).alias("n"), F.when(fresh, k).otherwise(a["at"]).alias("at"))
        return let(
            new,
            lambda b: F.struct(
                b["n"].alias("n"),
                b["at"].alias("at"),
                b["s"].alias("score"),
                F.greatest(a["best"], b["s"]).alias("best"),
                F.when(b["s"] > a["best"], b["n"]).otherwise(a["n_match"]).alias("n_match"),
                F.when(b["s"] > a["best"], b["at"]).otherwise(a["item_start"]).alias("item_start"),
                F.when(b["s"] > a["best"], k - b["at"] + 1).otherwise(a["n_tokens"]).alias("n_tokens"),
                (a["n_equal"] + same.cast("int")).alias("n_equal"),
            ),
        )

    def outcome(a: Column) -> Column:
        whole = a["n_equal"] * 100 >= F.size(item) * WHOLE_PERCENT
        return F.struct(
            F.when(whole, a["n_equal"]).otherwise(a["n_match"]).alias("n_match"),
            (-shift).alias("back"),
            F.when(whole, 0).otherwise(a["item_start"]).alias("item_start"),
            F.when(whole, F.size(item)).otherwise(a["n_tokens"]).alias("n_tokens"),
            a["n_equal"].alias("n_equal"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step, outcome)


def verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), item_id, item_tokens and the best overlap ``o`` of every pair that counts.

    A document with hits is tokenised once; the diagonals of a document and an item are one row of distinct shifts, of
    which there are no more than the two have tokens, however often a text repeats itself.
    """
    wanted = materialize(benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0), "items")
    short = wanted.where(F.size("item") < LEAST_MATCHES).select(F.size("item").alias("n")).distinct().collect()
    lengths = tuple(sorted(r.n for r in short))  # eleven numbers at most
    test = materialize(wanted.select("item_id", F.explode(seeds(F.col("item"), lengths, own=True)).alias("w")).select("item_id", F.col("w.at").alias("j"), "w.seed").distinct(), "item-seeds")
    known = F.broadcast(test) if test.count() <= BROADCAST_ROWS else test
    key = F.xxhash64("text").alias("text_key")
    train = docs.select("doc_id", key, F.explode(seeds(tokens(F.col("text")), lengths)).alias("w")).select("doc_id", "text_key", F.col("w.at").alias("i"), "w.seed")
    hits = train.join(known, "seed").select("doc_id", "text_key", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct()
    hits = materialize(hits.groupBy("doc_id", "text_key", "item_id").agg(F.collect_list("shift").alias("shifts")), "hits")
    hit = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    rows = docs.select("doc_id", key, "text")
    rows = rows.join(hit, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")), "left_semi")
    rows = materialize(rows.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), tokens(F.col("text")).alias("doc")), "hit-documents")
    found = hits.join(rows, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).join(wanted, "item_id")
    best = F.array_max(F.transform("shifts", lambda s: overlap(F.col("doc"), F.col("item"), s)))
    found = found.select("doc_id", "text_key", "item_id", F.size("item").alias("item_tokens"), best.alias("o"))
    discard(test)
    return found.where((F.col("o.n_match") >= LEAST_MATCHES) | (F.col("o.n_equal") * 100 >= F.col("item_tokens") * WHOLE_PERCENT))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_match, n_tokens, doc_start, item_start and item_tokens: the best verified overlap of each pair.

    Whole texts on both sides. Seeds of all documents meet the seeds of all items in one join on the hash; what shares
    one is verified on the tokens along its diagonals. An item of fewer than LEAST_MATCHES tokens is found with any one
    token substituted (not under five tokens, where one is over a fifth), and one of up to three tokens where it is the whole
    document. Of equally good diagonals the one that starts first in the document counts.

    Null and empty texts have no tokens; an item without a token is never found. Rows with equal doc_id are one document as
    far as the result goes, the best of their overlaps counts; a null doc_id is one document too. Other columns are ignored;
    an empty table on either side gives no rows.
    """
    found = verified(docs, benchmark)
    best = F.max(F.struct("o.n_match", "o.back", "o.item_start", "o.n_tokens", "item_tokens"))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.n_match", "b.n_tokens", (F.col("b.item_start") - F.col("b.back")).alias("doc_start"), "b.item_start", "b.item_tokens")


def benchmark_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def remove_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap that counts. Rows go by doc_id and text; nulls, empty texts and any other columns stay as they are."""
    leaked = verified(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    left = rows.join(leaked, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("k")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with an overlap go; see ``overlaps`` and ``remove_leaked`` for nulls, empty and very long
    texts, ties, repeated rows, empty tables and other columns."""
    return remove_leaked(docs, benchmark_of(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item; see ``overlaps``."""
    return overlaps(documents(spark, sf_dir), benchmark_of(spark, sf_dir))


QUERIES = {"op4_decontaminate": op4_decontaminate}
SQL: dict[str, str] = {}

"""Sharding by weighted rendezvous hashing: the law ``key``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import documents, let

SHARDS = 40
#: Slots are counted within so many parts of each shard, so that no task has to sort a whole shard.
PARTS = 256


def scores(key: Column, weights: Sequence[float]) -> Column:
    """For each shard (score, shard): -weight / ln(u), where u in (0, 1) is a hash of key and shard.

    The largest score wins the key. It doesn't depend on the other shards, so one more shard takes keys only into
    itself, and a shard of twice the weight gets twice the keys. Null keys hash as the empty text, all to one shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    weight = F.array(*[F.lit(float(w)) for w in weights])

    def score(shard: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), shard.cast("string"))), 1, 12), 16, 10).cast("long")
        return F.struct((-weight[shard] / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 48)))).alias("score"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score)


def shard_documents(docs: DataFrame, weights: Sequence[float], added: float = 1.0, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard of weight ``added``) for every row.

    Slots number a shard's rows from 0: by part (a hash of doc_id), then doc_id, size and crc. Equal rows are counted
    before the shuffle and spread again after it, so that one row repeated many times is one row for the sort. The
    counts of the parts (at most shards x parts rows, 10,240 for the query) are the only broadcast.

    A null text has size 16 and crc 0; a null doc_id is a key as any other; ties of score go to the larger shard
    number; repeated rows get a slot each; other columns are ignored; an empty table gives no rows.
    """
    n = len(weights)
    key = docs.select(
        "doc_id",
        "text",
        let(
            scores(F.col("doc_id"), [*weights, added]),
            lambda s: F.struct(F.array_max(F.slice(s, 1, n))["shard"].alias("shard"), F.array_max(s)["shard"].alias("grown_shard")),
        ).alias("to"),
        F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int").alias("part"),
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        key.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            "to.shard",
            "to.grown_shard",
            "part",
        )
        .groupBy("shard", "part", "doc_id", "size", "text_crc32", "grown_shard")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = rows.groupBy("shard", "part").agg(F.sum("n").alias("part_n"))  # over the same shuffle as the rows
    first = counts.select(
        "shard", "part", (F.sum("part_n").over(Window.partitionBy("shard").orderBy("part")) - F.col("part_n")).alias("first")
    )
    within = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    placed = rows.withColumn("upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(F.broadcast(first), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("first") + F.col("upto") - F.col("n"), F.col("first") + F.col("upto") - 1)).alias("slot"),
        "grown_shard",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in shards 0 to 39 of equal weight."""
    return shard_documents(documents(spark, sf_dir), [1.0] * SHARDS)


QUERIES = {"op6_sharding": op6_sharding}
SQL: dict[str, str] = {}

"""Shared helpers of the training-data operators: lambda bindings, the shared folder, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_SPLIT = "[ \\t-\\r]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` evaluated once: the optimizer never copies an expression into a lambda's uses of it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_SPLIT)),
    )


def text_keys(column: str) -> dict[str, Column]:
    """Two 64-bit hashes that stand for a text: 128 bits, which don't collide at any size of corpus."""
    return {"h1": F.xxhash64(column), "h2": F.xxhash64(F.lit(7), column)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, as they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    at = tempfile.mkdtemp(prefix="loomframe-")  # the driver serves it from here as long as it lives
    atexit.register(shutil.rmtree, at, True)
    archive = f"{at}/loomframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests, local mode) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own.append("file://" + tempfile.mkdtemp(prefix="loomframe-"))
    return _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        return


_tables: list[str] = []


def materialize(df: DataFrame, name: str, *seen: Column) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and a lost executor loses nothing.

    The files go when the Python process ends; ``discard`` removes them earlier. seen: aggregates of the rows, by name, which
    are made as they are written, for ``seen_in``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    found = Observation() if seen else None
    (df.observe(found, *seen) if found else df).write.option("compression", "zstd").parquet(path)
    _tables.append(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomframe_path = path
    out._loomframe_seen = found.get if found else {}
    return out


def seen_in(table: DataFrame) -> dict:
    return table._loomframe_seen


def discard(df: DataFrame) -> None:
    """Removes what ``materialize`` wrote, and lets Spark drop the shuffle files that only it needed."""
    path = getattr(df, "_loomframe_path", None)
    if path in _tables:
        _tables.remove(path)
        _delete(df.sparkSession, path)


def tables() -> list[str]:
    """What ``materialize`` has written and nothing has discarded."""
    return list(_tables)


def sweep(spark: SparkSession, keep: list[str]) -> None:
    """Discards all tables but these: what an operator's result was read from, once that result is a table of its own."""
    for path in set(_tables) - set(keep):
        _tables.remove(path)
        _delete(spark, path)
    release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): each node of the undirected edges (a, b) with the smallest node it can reach.

    Alternating large-star and small-star steps: every step links a node's neighbours to the smallest of them. A node's
    minimum is an aggregate with partial sums and the links go back over a join that splits skewed keys, so that a hub
    with a third of all links is never gathered in one task. Links stay in tables of the shared folder; only two
    numbers for each step reach the driver. Self links and nulls are ignored; no links give no rows.
    """
    state = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    links = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, *state)
    while seen_in(links)["n"]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("c"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        new = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), name, *state)
        discard(links)
        before, links = links, new
        if seen_in(before) == seen_in(links):
            break
    release(edges.sparkSession)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) with a > b of each key's nodes with one of them, and (key, node, b) with that one of the keys of three nodes and more.

    The one is the most popular: whose keys have the most nodes in all, as an original has against its altered copies,
    which are often too far from each other.
    """
    counts = members.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts, f"{name}-counts")
    several = materialize(members.join(counts.where("n > 2").select("key", "n"), "key"), f"{name}-several")
    release(members.sparkSession)
    fame = several.groupBy("node").agg(F.sum("n").alias("fame"))
    best = F.max_by(F.col("node"), F.struct("fame", -F.col("node"))).alias("b")
    middle = materialize(several.select("key", "node").join(fame, "node").groupBy("key").agg(best), f"{name}-middle")
    busy = materialize(several.select("key", "node").join(middle, "key"), f"{name}-busy")
    spokes = busy.where("node <> b").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
    pairs = materialize(counts.where("n = 2").select("a", "b").unionByName(spokes).distinct(), f"{name}-pairs")
    for table in (counts, several, middle):
        discard(table)
    release(members.sparkSession)
    return pairs, busy


def _apart(busy: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """(key, node, c, main) of the keys whose nodes are in several components: a node's own and that of the key's one."""
    named = busy.join(groups.withColumnRenamed("component", "c"), "node", "left").select("key", "b", "node", F.coalesce("c", "node").alias("c"))
    named = materialize(named, f"{name}-named")
    main = F.max(F.when(F.col("node") == F.col("b"), F.col("c"))).alias("main")
    split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), main).where("lo <> hi")
    split = materialize(split.select("key", "main"), f"{name}-split")
    out = materialize(named.join(split, "key").select("key", "node", "c", "main"), f"{name}-apart")
    discard(named)
    discard(split)
    return out


#: A sketch has LANES slots of a signature, a byte each, in words of seven bytes: the eighth stays free, so that sums don't overflow.
WORDS, LANES = 9, 63
_ONES = sum(1 << 8 * k for k in range(7))


def equal_lanes(x: str, y: str) -> Column:
    """How many lanes of two sketches are equal: those whose bytes of the exclusive or are 0."""
    n = F.lit(LANES)
    for w in range(WORDS):
        v = F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))
        some = (v.bitwiseAND(F.lit(_ONES * 0x7F)) + F.lit(_ONES * 0x7F)).bitwiseOR(v).bitwiseAND(F.lit(_ONES * 0x80))
        n = n - F.bit_count(some)
    return n


def least_lanes(percent: int) -> int:
    """So many lanes at least are equal for a pair of this similarity, but for a chance of 1 in 10,000 (four standard deviations)."""
    p = percent / 100 + (1 - percent / 100) / 256
    return int(LANES * p - 4 * (LANES * p * (1 - p)) ** 0.5)


def banded_components(members: DataFrame, verify, compare, name: str) -> DataFrame:
    """(node, component) for the nodes that are linked through the keys they share.

    members: distinct rows (key, node). verify: of rows (a, b) gives a materialized table of those that are links. compare:
    of rows (key, node, c, main) a materialized table of links (a, b) between components: it must find, in some key, every two
    linked nodes of different c of which one isn't of its key's component ``main``; b may be any node of the component.

    The nodes of a key are compared with one of them: one pair for each member, never all pairs of a group. What is
    linked then, through whatever keys, is one component. Only what a key still has in several components is left to
    ``compare``.
    """
    spark = members.sparkSession
    pairs, busy = _stars(members, name)
    links = verify(pairs)
    groups = materialize(connected_components(links, name), name)
    apart = _apart(busy, groups, name)
    if apart.isEmpty():
        for table in (pairs, busy, apart, links):
            discard(table)
        return groups
    new = compare(apart)
    if not new.isEmpty():
        old = links, groups
        links = materialize(links.unionByName(new), f"{name}-links")
        groups = materialize(connected_components(links, name), name)
        for table in old:
            discard(table)
    for table in (pairs, busy, apart, links, new):
        discard(table)
    release(spark)
    return groups


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

"""Line dedup: MinHash over character shingles, banding, exact Jaccard verification and union-find, all in DataFrame operations."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import BLANKS, banded_components, discard, documents, let, materialize, nodes_of, release, text_keys

#: Shingles: so many characters from every character; a shorter line is one. In UTF-32 a character has WIDTH bytes, so
#: that a shingle is cut out of a line in constant time. For signatures UNIT bytes of UTF-16 are one: a character beyond
#: them counts twice there, by which altered copies are more alike, not less.
CHARS, PERCENT, WIDTH, UNIT = 8, 80, 4, 2
#: Each band is three of 2 * BANDS MinHash slots: one of its own and two that it shares with the bands before and after it.
#: A pair of similarity 0.8 shares none with a chance of 0.4 %, one of 0.9 with 1 in 10,000.
BANDS = 10
#: So many shingles go through the slots in one row.
STRIDE = 4
#: Nodes of a key that are still apart are compared with parts of about so many.
BLOCK = 2048
#: A parity sketch has so many words of 64 bits.
WORDS = 16
_RANDOM = random.Random(20)
_SLOTS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(2 * BANDS)]


def normal(line: Column) -> Column:
    """Lower case, without outer blanks; lines without any, most of them, aren't searched for them."""
    blank = F.lit(False)
    for c in BLANKS:
        blank = blank | line.startswith(c) | line.endswith(c)
    return F.lower(F.when(blank, F.btrim(line, F.lit(BLANKS))).otherwise(line))


def shingle_set(line: Column) -> Column:
    """Distinct hashes of the shingles from every character. Only the hashes are made in a lambda, which is interpreted."""
    size = CHARS * WIDTH

    def of(code: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.octet_length(code) - size + 1, F.lit(1)), F.lit(WIDTH))
        return F.transform(at, lambda i: F.xxhash64(F.substring(code, i, F.lit(size))))

    return F.array_distinct(let(F.encode(line, "UTF-32"), of))


def links_of(pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of rows (a, b, la, lb) whose lines' shingle sets have a Jaccard similarity of ``percent`` hundredths or more.

    Sets are made, intersected and judged in projections of their own, once and by generated code: in a lambda they would be
    interpreted, and a filter would be pushed below them and make them again. Nothing is pushed below an explode.
    """
    return alike(pairs.select("a", "b", shingle_set(F.col("la")).alias("x"), shingle_set(F.col("lb")).alias("y")), percent)


def links_among(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links of pairs (a, b) of few nodes that come in many pairs each; texts: rows (node, line).

    The set of a node is made once for all pairs that have it as b. For a its text goes to the pairs, as sets are eight times longer.
    """
    sets = texts.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    sets = sets.select(F.col("node").alias("b"), shingle_set(F.col("line")).alias("y"))
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").join(sets, "b")
    return alike(rows.select("a", "b", shingle_set(F.col("la")).alias("x"), "y"), percent)


def alike(sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of rows (a, b, x, y) whose shingle sets x and y are as similar as that; see ``links_of``."""
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    near = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent
    shared = F.when(near, F.size(F.array_intersect("x", "y"))).otherwise(0)
    sizes = sets.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), shared.alias("k"))
    link = F.when(k * 100 >= (m + n - k) * percent, F.array(F.struct("a", "b")))
    return sizes.select(F.explode(link).alias("link")).select("link.a", "link.b")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), line_no (from 0), the normal form of every line that has a word, and its 128-bit hash (h1, h2)."""
    raw = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    # judged on the raw line, as a filter on the normal form would make that twice; few lines begin with a blank
    blank = reduce(Column.__or__, [F.col("raw").startswith(c) for c in BLANKS])
    raw = raw.where(F.when(blank, F.btrim("raw", F.lit(BLANKS))).otherwise(F.col("raw")) != "")
    return raw.select("doc_id", "text_key", "line_no", normal(F.col("raw")).alias("line")).withColumns(text_keys("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """h1, h2, n (how often it comes) and the band keys of every different line.

    Shingles are rows of generated code, not arrays: a slot is the least of their hashes after an exclusive or with its
    own constant, which is a permutation; an aggregate with partial sums takes it.
    """
    size = CHARS * UNIT
    last = F.greatest(F.octet_length("code") - size + 1, F.lit(1))
    starts = F.sequence(F.lit(1), last, F.lit(UNIT * STRIDE))
    rows = lines.select("h1", "h2", F.encode("line", "UTF-16BE").alias("code")).select("h1", "h2", "code", F.explode(starts).alias("i"))

    def shingle(k: int) -> Column:
        # beyond the last one the last one again, so that there are no nulls to look for
        at = F.least(F.col("i") + k * UNIT, last) if k else F.col("i")
        return F.xxhash64(F.substring(F.col("code"), at, F.lit(size))).alias(f"x{k}")

    rows = rows.select("h1", "h2", "i", *[shingle(k) for k in range(STRIDE)])
    slots = [F.min(F.least(*[F.col(f"x{k}").bitwiseXOR(F.lit(c)) for k in range(STRIDE)])).alias(f"s{j}") for j, c in enumerate(_SLOTS)]
    found = rows.groupBy("h1", "h2").agg(F.count(F.when(F.col("i") == 1, 1)).alias("n"), *slots)
    keys = [F.xxhash64(F.lit(b), f"s{b}", f"s{BANDS + b}", f"s{BANDS + (b + 1) % BANDS}") for b in range(BANDS)]
    return found.select("h1", "h2", "n", F.array(*keys).alias("keys"))


def parities(texts: DataFrame) -> DataFrame:
    """node, n (the size of its shingle set) and the words p0, p1 ... of its parity sketch, of rows (node, line).

    A bit of the sketch is the parity of the shingles that fall on it, so that the exclusive or of two sketches is the sketch
    of the symmetric difference, and its bits that are set are no more than that difference has shingles.
    """
    rows = texts.select("node", F.explode(shingle_set(F.col("line"))).alias("h"))
    bit, word = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.expr(f"shiftrightunsigned(h, 6) % {WORDS}")
    rows = rows.select("node", bit.alias("bit"), word.alias("word"))
    words = [F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0))).alias(f"p{w}") for w in range(WORDS)]
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *words)


def may_link(x: str, y: str, percent: int) -> Column:
    """False only for pairs that can't be links, by the sizes and sketches in columns of these prefixes: a set of m shingles and one of n
    have a similarity of (m + n - d) / (m + n + d), d the size of their symmetric difference, and d isn't below the sketches' difference."""
    d = reduce(Column.__add__, [F.bit_count(F.col(f"{x}p{w}").bitwiseXOR(F.col(f"{y}p{w}"))) for w in range(WORDS)])
    m, n = F.col(f"{x}n"), F.col(f"{y}n")
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (d * (100 + percent) <= (m + n) * (100 - percent))


def line_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, line_no, first_doc_id, first_line_no and kept for every line that has a copy or near copy.

    Every line with a word counts, however short or long. Lines are compared without case and outer blanks. Equal lines
    are one node from the start (by a 128-bit hash). Nodes that share a band are compared by ``banded_components``; a link
    is a Jaccard similarity of the lines' full sets of 8-character shingles of ``percent`` hundredths or more. Of each
    component the first line stays: least doc_id, then least line_no, then least text_key (which counts where ids are null
    or repeat with other texts).

    Null and empty texts have no lines. Rows with the same doc_id and text are one document: their lines are alike, and
    repeats between them don't count. A null doc_id comes first. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lines = lines_of(docs)
    one = materialize(signatures(lines).withColumn("node", F.monotonically_increasing_id()), "line-one")
    release(spark)
    placed: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        """The first pairs have all nodes that any have: one more pass over the lines finds their texts, and where repeated lines are."""
        if not placed:
            paired = nodes_of(pairs).withColumn("paired", F.lit(True))
            wanted = one.select("h1", "h2", "node", "n").join(paired, "node", "left").where("n > 1 or paired").select("h1", "h2", "node", "paired")
            found = lines.join(wanted.hint("shuffle_hash"), ["h1", "h2"])
            placed.append(materialize(found.select("node", "doc_id", "text_key", "line_no", F.when(F.col("paired"), F.col("line")).alias("line")), "line-places"))
            release(spark)
            placed.append(materialize(placed[0].where("line is not null").select("node", "line").dropDuplicates(["node"]), "line-texts"))
            release(spark)
        a, b = (placed[1].select(F.col("node").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
        links = materialize(links_of(pairs.join(b, "b").join(a, "a"), percent), "line-links")
        release(spark)
        return links

    def compare(rest: DataFrame) -> DataFrame:
        """Each stray with all nodes of its key, in parts of some BLOCK of these; sketches inside the join let only pairs out that may be links."""
        count = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        sketches = materialize(parities(placed[1].join(rest.select("node").distinct(), "node", "left_semi")), "line-parities")
        rows = rest.join(sketches, "node").join(count, "key")
        rows = materialize(rows.withColumn("stray", F.col("c") != F.col("main")).drop("main"), "line-rest")
        discard(sketches)
        release(spark)
        x = rows.where("stray").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        y = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        x, y = (t.select("key", "part", *[F.col(c).alias(f"{k}{c}") for c in t.columns if c not in ("key", "part", "parts")]) for k, t in (("x", x), ("y", y)))
        # two strays are compared once; a node beside the strays is of the main component
        apart = (F.col("xc") != F.col("yc")) & (~F.col("ystray") | (F.col("xnode") < F.col("ynode")))
        both = x.join(y.withColumnsRenamed({"key": "ykey", "part": "ypart"}), (F.col("key") == F.col("ykey")) & (F.col("part") == F.col("ypart")) & apart & may_link("x", "y", percent))
        likely = materialize(both.select(F.greatest("xnode", "ynode").alias("a"), F.least("xnode", "ynode").alias("b")).distinct(), "line-likely")
        discard(rows)
        links = materialize(links_among(likely, placed[1], percent), "line-links")
        release(spark)
        discard(likely)
        return links

    groups = banded_components(one.select("node", F.explode("keys").alias("key")), verify, compare, "line-groups")
    places, texts = placed
    discard(texts)
    discard(one)
    named = places.select("node", "doc_id", "text_key", "line_no").join(groups, "node", "left")
    named = materialize(named.select(F.coalesce("component", "node").alias("group"), "doc_id", "text_key", "line_no"), "line-named")
    discard(places)
    discard(groups)
    place = F.struct("doc_id", "line_no", "text_key")
    first = named.groupBy("group").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last or (first is null) <> (last is null)")
    first = materialize(first.select("group", "first"), "line-first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("text_key") == F.col("first.text_key"))
    return named.join(first, "group").select(
        "doc_id",
        "text_key",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line_no").cast("long").alias("first_line_no"),
        same.alias("kept"),
    )


def drop_lines(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents without the lines that aren't kept; those without a word left go. n_chars follows the text.

    Lines go by doc_id and text. Columns may have any names; null and empty texts stay as they are.
    """
    gone = groups.where("not kept").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    both = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("k")), "left")
    left = let(
        F.split("row.text", "\n"),
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: x[i]), "\n"),
    )
    both = both.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("left"))
    both = both.where(F.col("gone").isNull() | (F.btrim("left", F.lit(BLANKS)) != ""))
    n_chars = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long")) if "n_chars" in docs.columns else None
    new = {"text": F.col("left"), "n_chars": n_chars}
    return both.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of lines only the first stays; see ``line_groups`` and ``drop_lines`` for nulls, empty
    and very long texts, ties, repeated rows, empty tables and other columns."""
    return drop_lines(docs, line_groups(docs))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents that repeats, and whether it stays; see ``line_groups``."""
    return line_groups(documents(spark, sf_dir)).drop("text_key")


QUERIES = {"op2_lines": op2_lines}
SQL: dict[str, str] = {}

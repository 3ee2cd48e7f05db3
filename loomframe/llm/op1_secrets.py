"""Secret scans: known shapes by regular expressions, unknown ones by sliding-window Shannon entropy."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import documents, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
#: Runs of hex digits of 24 and more, and AKIA with 16 more: longer matches of the same start, so nothing else changes.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the entropy scan: all long runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Character classes: name, pattern of the whole candidate, alphabet, least entropy in bits of a character in some window.
#: The first that fits counts.
CLASSES = (
    ("entropy_hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 3.0),
    ("entropy_lower", r"^[0-9a-z]+$", _LOWER + _DIGITS, 3.6),
    ("entropy_letters", r"^[A-Za-z]+$", _UPPER + _LOWER, 3.8),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", _UPPER + _LOWER + _DIGITS + "+/_=-", 3.8),
)
#: Harmless strings: placeholders, runs and counts, UUIDs.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]?|xxxx|0123456789|123456789|abcdef0|abcdefgh|deadbeef|"
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9]+$"
)
#: What paths, slugs and names in code are made of: words in lower or camel case, capitals, short numbers, separators. A
#: candidate of nothing else is harmless too.
PLAIN = (
    r"[A-Z]?[a-z]{2,}(?:[0-9]{1,4}(?![0-9A-Za-z]))?|(?:By|To|Of|In|At|On|Is|As|It|Or|An|If|Id|My|No|Up)(?![a-z])|"
    r"(?<![A-Za-z0-9])[A-Z]+(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Za-z]?[0-9]{0,4}(?![A-Za-z0-9])|[-_/=+]"
)
#: Matches of a text are placed in blocks of so many: an array that grows is copied with every element.
BLOCK = 64
KINDS = ("assign", "access", "hex", *[name for name, *_ in CLASSES])


def entropy_peak(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of the windows of a text, by incremental counts.

    One character enters the window and one leaves; of the sum of c log c only their two terms change. Texts shorter
    than the window count as one window; characters outside the alphabet share a count.
    """
    other = len(alphabet)
    table = [0.0] + [k * log2(k) for k in range(1, window + 1)]

    def step(codes: Column, terms: Column) -> Column:
        def move(a: Column, i: Column) -> Column:
            new = codes[i]
            old = F.when(i >= window, codes[F.greatest(i - window, F.lit(0))]).otherwise(F.lit(-1))
            added = F.transform(a["n"], lambda c, k: c + (k == new).cast("int"))
            total = a["s"] + terms[F.least(a["n"][new] + 1, F.lit(window))] - terms[F.least(a["n"][new], F.lit(window))]
            return let(
                F.struct(added.alias("n"), total.alias("s")),
                lambda b: let(
                    F.when(
                        old >= 0,
                        F.struct(
                            F.transform(b["n"], lambda c, k: c - (k == old).cast("int")).alias("n"),
                            (b["s"] + terms[F.greatest(F.get(b["n"], old) - 1, F.lit(0))] - terms[F.least(F.get(b["n"], old), F.lit(window))]).alias("s"),
                        ),
                    ).otherwise(b),
                    lambda c: F.struct(
                        c["n"].alias("n"), c["s"].alias("s"), F.when(i >= F.least(F.lit(window), F.size(codes)) - 1, F.least(a["low"], c["s"])).otherwise(a["low"]).alias("low")
                    ),
                ),
            )

        n = F.least(F.lit(window), F.size(codes)).cast("double")
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            F.struct(F.array_repeat(F.lit(0), other + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("low")),
            move,
            lambda a: F.log2(n) - a["low"] / n,
        )

    codes = F.transform(F.split(text, ""), lambda c: let(F.instr(F.lit(alphabet), c), lambda k: F.when(k > 0, k - 1).otherwise(F.lit(other))))
    return let(F.array(*[F.lit(x) for x in [*table, table[-1]]]), lambda terms: let(codes, lambda c: step(c, terms)))


def matches(text: Column, pattern: str, keep=None) -> Column:
    """The leftmost non-overlapping matches as (start, end, value), in code points, ends exclusive.

    What lies between the matches comes from a split by the same pattern; it is only made where there is a match.
    """

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def in_block(pieces: Column, at: Column) -> Column:
        return F.aggregate(
            pieces,
            F.struct(at.alias("at"), none.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["g"] + F.length(x["v"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + F.length(x["v"])).alias("e"), x["v"].alias("v")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    def placed(found: Column) -> Column:
        def of(pieces: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(BLOCK)), lambda b: F.slice(pieces, b + 1, F.lit(BLOCK)))
            lengths = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y["g"] + F.length(y["v"])))
            starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
            return let(blocks, lambda x: let(starts, lambda at: F.flatten(F.transform(x, lambda y, k: in_block(y, at[k])))))

        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return let(F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v"))), of)

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))
    return F.filter(out, keep) if keep else out


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def entropy_spans(text: Column) -> Column:
    """Spans (s, k, e) of candidates with a window of high entropy for their character class, unless allow-listed."""

    def judged(x: Column) -> Column:
        kind = F.lit(-1)
        for k in range(len(CLASSES) - 1, -1, -1):
            name, pattern, alphabet, least = CLASSES[k]
            value = F.lower(x["v"]) if name == "entropy_hex" else x["v"]
            kind = F.when(x["v"].rlike(pattern), F.when(entropy_peak(value, alphabet) >= least, F.lit(3 + k)).otherwise(F.lit(-1))).otherwise(kind)
        harmless = x["v"].rlike(ALLOWED) | (F.regexp_replace(x["v"], PLAIN, "") == "")
        return F.struct(x["s"].alias("s"), F.when(harmless, F.lit(-1)).otherwise(kind).alias("k"), x["e"].alias("e"))

    return F.filter(F.transform(matches(text, CANDIDATE), judged), lambda x: x["k"] >= 0)


def secret_spans(text: Column) -> Column:
    """All spans (s, k, e) of a whole text by start and kind; k counts in KINDS. Null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))

    def long_enough(x: Column) -> Column:
        return F.length(F.regexp_extract(x["v"], f"^{ASSIGN}$", 2)) >= 6

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    base = F.concat(
        _of_kind(matches(t, ASSIGN, long_enough), 0),
        F.when(F.contains(t, F.lit("AKIA")), _of_kind(matches(t, ACCESS), 1)).otherwise(none),
        _of_kind(matches(t, HEX), 2),
        entropy_spans(t),
    )
    return F.array_sort(base)


def listed(spans: Column, kinds: int = len(KINDS)) -> Column:
    """kind:start:end of the spans of the first kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter(spans, lambda x: x["k"] < kinds), lambda x: F.concat(names[x["k"]], F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and secrets for every row: an array of (kind, start, end, value) by start and kind.

    Null and empty texts have none. Rows don't depend on each other: ties and repeated rows are alike, other columns are
    ignored, an empty table gives no rows. Whole texts of any length; the work is linear in them.
    """

    def of(text: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        value = lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"])
        return F.transform(secret_spans(text), lambda x: F.struct(names[x["k"]].alias("kind"), x["s"].alias("start"), x["e"].alias("end"), value(x).alias("value")))

    return docs.select("doc_id", let(F.coalesce("text", F.lit("")), of).alias("secrets"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as counts and digests; one pass over the rows, each on its own; see ``find_secrets``."""

    def is_kind(k: int):
        return lambda x: x["k"] == k

    def row(s: Column) -> Column:
        return F.struct(
            *[F.size(F.filter(s, is_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(listed(s, 3), 256).alias("base_sha256"),
            listed(s).alias("spans"),
        )

    return documents(spark, sf_dir).select("doc_id", let(secret_spans(F.col("text")), row).alias("r")).select("doc_id", "r.*")


QUERIES = {"op1_secrets": op1_secrets}
SQL: dict[str, str] = {}

"""Quality rules, line first: lines that fail a rule go, and a document that loses too much of its text is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import BLANKS, documents, let, words_of

#: Navigation and notices: a line that is nothing but these, in the languages of the corpus.
ITEM = (
    r"(?:home|about(?: us)?|contact(?: us)?|menu|search|log ?(?:in|out)|sign (?:in|up|out)|next|previous|read more|share|"
    r"cookie (?:policy|settings)|privacy policy|terms (?:of|and) \w+|skip to content|back to top|subscribe|click here|"
    r"accueil|connexion|recherche|mentions l[ée]gales|lire la suite|suivant|pr[ée]c[ée]dent|"
    r"startseite|anmelden|suche|kontakt|impressum|datenschutz|weiterlesen|weiter|zur[üu]ck|"
    r"inicio|contacto|buscar|iniciar sesi[óo]n|aviso legal|leer m[áa]s|siguiente|anterior)(?![\p{L}\p{N}])[ \t|>»/.,!-]*"
)
NOTICE = r"(?i)^(?:(?:please )?(?:enable javascript|javascript (?:is|must be) (?:disabled|enabled))|(?:we|this (?:web)?site) uses? cookies)"
#: Words with symbols stuck to them, and separators of link lists.
SYMBOLED = r"[\p{L}\p{N}.,][#*$%&<>]{2,}(?=\s|$)|[#*$%&<>]{3,}"
SEPARATOR = r"(?:^|\s)[|>»•·]+(?=\s|$)"
SHOUTED = r"(?<![\p{L}\p{N}])\p{Lu}{2,}(?![\p{Ll}\p{N}])"
EXCLAIMED = r"!{2,}"
#: No other line can fail by the four above.
SUSPECT = r"[|>»•·#*$%&<{]|!!|\p{Lu}\p{Lu}"
#: A line of so many words has one of these somewhere if it is made of sentences.
PUNCTUATED, MANY_WORDS = r"[.!?…:;。！？؟।]", 12


def repeated_words(words: Column, n: int = 5) -> Column:
    """How many words are in windows of n words that the text has twice or more, the first of them included.

    64-bit hashes stand for the windows of one text. Only a text whose hashes aren't all different has them sorted.
    """

    def covered(h: Column) -> Column:
        return let(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.aggregate(
                F.array_sort(
                    F.transform(
                        F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i + n - a["end"])).alias("n"), (i + n).alias("end")),
                lambda a: a["n"],
            ),
        )

    hashes = let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(n)])),
    )
    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > n, repeats).otherwise(F.lit(0)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether one line is navigation, symbols, shouting, boilerplate or many words without punctuation. A line without a word never fails."""

    def rules(t: Column) -> Column:
        blanks = F.size(F.split(t, r"\s+"))
        return (
            (F.regexp_count(t, F.lit(SEPARATOR)) * 4 >= blanks)
            | (F.regexp_count(t, F.lit(SYMBOLED)) * 4 >= blanks)
            | ((F.regexp_count(t, F.lit(SHOUTED)) * 2 >= blanks) & (blanks >= 4))
            | ((F.regexp_count(t, F.lit(EXCLAIMED)) * 3 >= blanks) & (blanks >= 4))
            | F.contains(t, F.lit("{{"))
        )

    def navigation(t: Column) -> Column:
        # items are taken away one after the other: a repeated group would need stack for each of them
        return t.rlike(f"(?i)^{ITEM}") & (F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}])" + ITEM, "") == "")

    def plain(t: Column) -> Column:
        return ~t.rlike(PUNCTUATED) & (F.size(F.split(t, r"\s+")) >= MANY_WORDS)

    return let(
        F.btrim(line, F.lit(BLANKS)),
        lambda t: (t.rlike(SUSPECT) & rules(t)) | navigation(t) | t.rlike(NOTICE) | F.contains(t, F.lit("orem ipsum")) | plain(t),
    )


def judged(text: Column, most_lost: float = 0.4) -> Column:
    """The counts, the verdict and the ``clean`` text of one text, as a struct.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. clean: the text without the
    lines that fail; lost_chars: the characters of these. kept: not base_failed, and lost_chars is at most ``most_lost`` of
    the lines' characters. A null text counts as empty.
    """

    def by_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def chars(lines: Column) -> Column:
        return F.length(F.array_join(lines, "")).cast("long")

    def with_word(lines: Column) -> Column:
        return F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def by_line(lines: Column) -> Column:
        def of(full: Column, clean: Column) -> Column:
            return F.struct(
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                chars(full).alias("line_chars"),
                (chars(full) - chars(with_word(clean))).alias("lost_chars"),
                F.array_join(clean, "\n").alias("clean"),
            )

        return let(with_word(lines), lambda full: let(F.filter(lines, lambda x: ~line_fails(x)), lambda clean: of(full, clean)))

    def verdict(t: Column, w: Column, x: Column) -> Column:
        failed = (w["n_words"] < 10) | (w["n_repeat_words"] * 100 > w["n_words"] * 20)
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            x["lost_chars"].alias("lost_chars"),
            failed.alias("base_failed"),
            (~failed & (x["lost_chars"] <= x["line_chars"] * most_lost)).alias("kept"),
            x["clean"].alias("clean"),
        )

    t = F.coalesce(text, F.lit(""))
    return let(let(words_of(text), by_words), lambda w: let(let(F.split(t, "\n"), by_line), lambda x: verdict(t, w, x)))


def quality(docs: DataFrame, text: str = "text", most_lost: float = 0.4, name: str = "_q") -> DataFrame:
    """Adds to every row one struct ``name``, see ``judged``; a column that has this name already is replaced.

    Null, empty and blank texts have no words and fail. One pass over the rows without a shuffle; nothing depends on other
    rows, so ties and repeated rows are alike, and an empty table gives no rows. Very long texts are held as arrays of their
    words and lines, a few times their size.
    """
    return docs.withColumn(name, judged(F.col(text), most_lost))


def clean_documents(docs: DataFrame, most_lost: float = 0.4) -> DataFrame:
    """The documents that are kept, without the lines that fail; n_chars, if there is such a column, follows the text.

    Null, empty and blank texts go. Rows don't depend on each other; other columns, of any name, stay as they are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    # a filter on the verdict would be pushed below it and judge each text a second time: nothing is pushed below an explode
    kept = F.filter(F.array(judged(F.col("row.text"), most_lost)), lambda q: q["kept"])
    rows = rows.select("row", F.explode(kept).alias("q"))
    same = F.col("q.lost_chars") == 0
    new = {"text": F.col("q.clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("q.clean").cast("long"))
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines that fail a rule go, and documents that lose too much by it; see ``clean_documents`` for nulls,
    empty and very long texts, ties, repeated rows, empty tables and other columns."""
    return clean_documents(docs)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    found = documents(spark, sf_dir).select("doc_id", judged(F.col("text")).alias("q"))
    return found.select("doc_id", "q.*").drop("clean")


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}

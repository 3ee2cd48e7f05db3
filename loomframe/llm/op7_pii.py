"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import documents, ship

#: Kinds in the order in which spans that start together are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing")
THRESHOLD = 0.6
#: How many characters before and after a span may hold a context word.
REACH = 48
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|reply|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|server|host|login|logged|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|telephone|tel|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|bic|swift|konto|compte|cuenta|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax id|taxpayer)\b"),
    "routing": re.compile(r"(?i)\b(?:routing|aba|rtn|transit)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:example|sample|test|dummy|isbn|order|invoice|part|sku|version)\b")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Before a digit there is no other: where a run of digits fails from its first digit, it fails from all. Possessive
# quantifiers keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NINE = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN: letters count from 10, the first four characters go to the end, the rest by 97 is 1."""
    code = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def aba(digits: str) -> bool:
    return digits != "000000000" and sum(w * int(c) for w, c in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the base pattern finds them, but outwards from each @, so that long runs of letters cost no more than once."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, (end := m.end())
            free = end
        at = text.find("@", end)


def _score(kind: str, base: float, text: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    return base + 0.35 * bool(_CONTEXT[kind].search(near)) - 0.25 * bool(_AGAINST.search(near))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


def added_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of the kinds that checksums and context words confirm."""
    if not _DIGIT.search(text):
        return []
    found = []
    for m in _IBAN.finditer(text):
        # The pattern may run on into a following word in capitals: shorter readings that end at a blank are tried too.
        code = m[0]
        while len(code.replace(" ", "")) >= 15:
            if mod97(code) and (score := _score("iban", 0.7, text, m.start(), m.start() + len(code))) >= 0.4:
                found.append((m.start(), 4, m.start() + len(code), score))
                break
            if " " not in code:
                break
            code = code.rpartition(" ")[0]
    for m in _SSN.finditer(text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" and (score := _score("ssn", 0.4, text, m.start(), m.end())) >= THRESHOLD:
            found.append((m.start(), 5, m.end(), score))
    for m in _NINE.finditer(text):
        if aba(m[0]) and (score := _score("routing", 0.3, text, m.start(), m.end())) >= THRESHOLD:
            found.append((m.start(), 6, m.end(), score))
    return found


def find_spans(text: str | None) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of all personal data in a whole text, by start and kind; none for null and empty.

    Positions are code points, ends exclusive. The base kinds stay whatever their score is, which the words nearby give; a card
    that passes its checksum has more to begin with. Spans of different kinds may overlap.
    """
    if not text:
        return []
    both = [(s, k, e, _score(KINDS[k], 0.65 if k == 2 else 0.6, text, s, e)) for s, k, e in base_spans(text)] + added_spans(text)
    return [(s, KINDS[k], e, p) for s, k, e, p in sorted(both)]


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of spans that overlap, one replacement for their union."""
    if not text:
        return text
    out, at, last = [], 0, -1
    for s, kind, e, _ in find_spans(text):
        if s >= max(at, 0) and s >= last:
            out += [text[at:s], f"[{kind}]"]
        at = last = max(at, e)
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e, "score": round(p, 2)} for s, k, e, p in find_spans(v.as_py())] for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "found"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and found for every row: an array of (kind, start, end, score) by start and kind, see ``find_spans``.

    Null and empty texts have none. Rows don't depend on each other: ties and repeated rows are alike, an empty table gives
    no rows, other columns are ignored. Whole texts of any length; every pattern is linear in it. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,score:double>>")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, as counts and digests; see ``personal_data``. scores is parallel to spans."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")

    def is_kind(*kinds: str):
        return lambda x: x["kind"].isin(*kinds)

    found = personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(F.filter("found", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(F.filter("found", is_kind(*KINDS[:4]))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}

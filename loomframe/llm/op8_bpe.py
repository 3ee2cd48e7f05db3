"""Byte-level BPE: a minimal perfect hash finds whole pre-tokens in the vocabulary, a heap merges the bytes of the rest."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import documents, ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encodings of pre-tokens that a Python worker keeps; when there are more it starts anew, so that memory is bounded.
KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings to 0..n-1 by hash and displace, with the keys kept to tell strangers.

    Keys are dealt to n / 3 buckets; the buckets, largest first, each get the first seed that sends all their keys to
    free slots. Buckets of one key come last and name a free slot outright (as -1 - slot). Looking a key up takes two
    hashes and one comparison.
    """

    def __init__(self, items: dict[bytes, int]):
        hashed = xxhash.xxh3_64_intdigest
        n = self.n = len(items)
        self.buckets = max(1, n // 3)
        dealt: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in items:
            dealt[hashed(key) % self.buckets].append(key)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        free = n - 1
        for k in sorted(range(self.buckets), key=lambda k: -len(dealt[k])):
            if not (keys := dealt[k]):
                break
            if len(keys) == 1:
                while self.keys[free] is not None:
                    free -= 1
                seed, slots = -1 - free, [free]
            else:
                seed = 0
                while True:
                    seed += 1
                    slots = []
                    for key in keys:
                        if self.keys[s := hashed(key, seed) % n] is not None or s in slots:
                            break
                        slots.append(s)
                    else:
                        break
            self.seeds[k] = seed
            for key, s in zip(keys, slots, strict=True):
                self.keys[s], self.values[s] = key, items[key]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        s = -1 - seed if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.values[s] if self.keys[s] == key else None


class Merger:
    """Merges of the bytes of a pre-token that isn't in the vocabulary: always the pair of least rank, the leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __call__(self, token: bytes) -> list[int]:
        rank = self.ranks.get
        n = len(token)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here any more
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != e:  # one of the two has been merged meanwhile
                continue
            end[mid], end[i] = 0, e
            if e < n:
                prev[e] = i
                if (r := rank(token[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := rank(token[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(rank(token[i : end[i]]))
            i = end[i]
        return out


def _class(prop: str) -> str:
    """The characters below U+10000 of a property as ranges, so that the standard library's faster matcher knows them."""
    member = regex.compile(prop).match
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and member(chr(c))]
    out, first = [], None
    for c, following in zip(points, [*points[1:], None], strict=True):
        first = c if first is None else first
        if following != c + 1:
            out.append(re.escape(chr(first)) + (f"-{re.escape(chr(c))}" if c > first else ""))
            first = None
    return "".join(out)


class Encoder(dict):
    """Pre-token to its ids as text (`` 12 345``), filled as pre-tokens come up."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.merge = Merger(self.ranks)
        self.bytes_of = {f"{rank}": token for token, rank in self.ranks.items()}
        self.split_all = regex.compile(pattern).findall
        letter, number, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
        plain = pattern
        for was, now in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"), (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"(?!\S)", f"(?![^{space}])"), (r"\s", f"[{space}]")):
            plain = plain.replace(was, now)
        self.split_plain = re.compile(plain).findall if "\\p" not in plain and "\\s" not in plain else self.split_all

    def ids(self, token: bytes) -> list[int]:
        return [found] if (found := self.whole.get(token)) is not None else self.merge(token)

    def __missing__(self, token: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        out = self[token] = " ".join(map(str, self.ids(token.encode())))
        return out

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, joined by blanks."""
        split = self.split_plain if text.isascii() or max(text) < "\U00010000" else self.split_all
        return " ".join(map(self.__getitem__, split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker; the vocabulary is a file of the installed tokenizers on every machine."""
    return Encoder(path, pattern)


def tokenizer_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text, and ``ids`` (array<int>) if asked for.

    Null and empty texts have no tokens; their decoded text is empty. Rows don't depend on each other: repeated rows,
    null ids and other columns change nothing. One pass in Arrow batches (bounded by Spark in rows and bytes), no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha, listed = [], [], [], []
            for value in batch.column(1):
                ids = enc.encode(value.as_py() or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha256(ids.encode()).hexdigest())
                decoded_sha.append(sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    listed.append([int(x) for x in ids.split(" ")] if ids else [])
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(listed, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the token ids of every document that is left."""
    return encode_documents(docs, *tokenizer_file(), with_ids=True)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode_documents(documents(spark, sf_dir), *tokenizer_file())


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}

"""Byte-level BPE over distinct words.

A task numbers the distinct words of its documents and folds the ranked merges over the bytes of each
distinct word; the ids of a document are then the concatenation of its words' ids. Nothing is shuffled and nothing grows with the corpus: a
task forgets its words when it has WORD_CACHE of them.

Bytes are written as characters U+0000 to U+00FF, one for each, so that pieces are strings to Spark.

Edge cases: a null text is empty; an empty text has no ids and decodes to nothing; repeated rows give
repeated results; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_CACHE, in_batches

#: Words of more bytes than this are merged with a heap: the fold's work grows with the square of a word.
FOLD_BYTES = 64
NO_RANK = 2**31 - 1
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 and rank, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(letter: str, end: int) -> str:
    """The characters of a general category, up to an end, as ranges of a character class."""
    out, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == letter
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def plain_pattern(pattern: str, end: int = 0x110000) -> str:
    """The pattern with its Unicode properties written out, up to an end, as classes that Python's re has."""
    sets = {r"\p{L}": _ranges("L", end), r"\p{N}": _ranges("N", end), r"\s": SPACE}
    out, inside, i = "", False, 0
    while i < len(pattern):
        for name, chars in sets.items():
            if pattern.startswith(name, i):
                out, i = out + (chars if inside else f"[{chars}]"), i + len(name)
                break
        else:
            if pattern.startswith(r"\S", i) and not inside:
                out, i = f"{out}[^{SPACE}]", i + 2
                continue
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out, i = out + pattern[i], i + 1
    return out


class Splitter:
    """Matches of a pattern. Classes without characters beyond U+FFFF match five times as fast, where a text has none."""

    def __init__(self, pattern: str) -> None:
        self.near, self.all = plain_pattern(pattern, 0x10000), plain_pattern(pattern)

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        near = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return re.findall(self.near if near else self.all, text)


def rank_literal(ranks: dict[bytes, int], buckets: int) -> Column:
    """The ranks as one literal: an array of small maps by hash, as a lookup in one large map is linear."""
    shelves: list[dict[str, int] | None] = [None] * buckets
    for piece, rank in ranks.items():
        b = xxhash.xxh64_intdigest((s := piece.decode("latin-1")).encode(), seed=42) % buckets
        shelves[b] = (shelves[b] or {}) | {s: rank}
    return F.from_json(F.lit(json.dumps(shelves, ensure_ascii=False)), "array<map<string,int>>")


def fold_merges(word: Column, ranks: Column, buckets: int) -> Column:
    """Ids of a word: of all neighbours the pair of lowest rank, the leftmost if equal, becomes one, again and again."""

    def rank(piece: Column) -> Column:
        shelf = F.element_at(ranks, (F.pmod(F.xxhash64(piece), F.lit(buckets)) + 1).cast("int"))
        return F.coalesce(F.element_at(shelf, piece), F.lit(NO_RANK))

    def best(parts: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.struct(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("rank"), i.alias("at")),
        )
        none = F.struct(F.lit(NO_RANK).alias("rank"), F.lit(0).alias("at"))
        return F.when(F.size(parts) > 1, F.array_min(pairs)).otherwise(none)

    def state(parts: Column) -> Column:
        return F.element_at(F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), best(p).alias("best"))), 1)

    def step(s: Column, _: Column) -> Column:
        at, parts = s["best"]["at"], s["parts"]
        pair = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
        merged = F.concat(F.slice(parts, F.lit(1), at - 1), pair, F.slice(parts, at + 2, F.size(parts)))
        return F.when(s["best"]["rank"] == NO_RANK, s).otherwise(state(merged))

    n = F.length(word)
    letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), n), state(letters), step, lambda s: F.transform(s["parts"], rank))
    return F.when(rank(word) != NO_RANK, F.array(rank(word))).otherwise(folded)


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a very long word, in time n log n."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(word[k : end[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: of all neighbours the pair of lowest rank, the leftmost if equal, becomes one, again and again."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > FOLD_BYTES:
        return merge_heap(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    pairs = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) != NO_RANK:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[x] for x in parts]


class _Index(dict):
    """Numbers of distinct words; new: those of the current document, bytes as characters."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word.encode("utf-8", "surrogatepass").decode("latin-1"))
        return i


class _Ids:
    """Ids of numbered words, one after another."""

    def __init__(self) -> None:
        self.flat, self.sizes, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.known = 0

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        n, m = self.known + len(sizes), self.used + len(values)
        while n > len(self.sizes):
            self.sizes, self.starts = np.concatenate([self.sizes, self.sizes]), np.concatenate([self.starts, self.starts])
        while m > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.sizes[self.known : n] = sizes
        self.starts[self.known : n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : m] = values
        self.known, self.used = n, m

    def of(self, words: np.ndarray) -> np.ndarray:
        n = self.sizes[words]
        return self.flat[np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (unsigned 32-bit integers, little-endian, one after another) of each text.

    Merges are folded over each distinct word of a task in Python; ``encode_sql`` folds them with
    Spark's higher-order functions, with the same results, at four times the CPU time."""
    find = Splitter(pattern)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: of the size of its file

    def run(batches):
        index, known, ranks = _Index(), _Ids(), shared.value
        for batch in batches:
            ids, counts = [], []
            for t in batch.column(1).to_pylist():
                if len(index) > WORD_CACHE:
                    index, known = _Index(), _Ids()
                found = find(t)
                words = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
                if index.new:
                    merged = [merge_word(w.encode("latin-1"), ranks) for w in index.new]
                    known.add(np.array([len(m) for m in merged]), np.array([i for m in merged for i in m], np.uint32))
                    index.new = []
                own = known.of(words)
                counts.append(len(own))
                ids.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["k", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(in_batches, run, f"k {kind}, n_tokens long, ids binary").withColumnRenamed("k", key)


def encode_sql(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", buckets: int = 65_536) -> DataFrame:
    """``encode`` with the merges folded by Spark's higher-order functions over a literal of the ranks.

    One pass numbers a task's distinct words, a projection folds the merges over the new ones of each
    row, and a second pass in the same task puts the ids together."""
    find = Splitter(pattern)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: of the size of its file

    def numbered(batches):
        index = _Index()
        for batch in batches:
            words, new, anew = [], [], []
            for t in batch.column(1).to_pylist():
                anew.append(len(index) > WORD_CACHE)
                if anew[-1]:
                    index = _Index()
                found = find(t)
                words.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)).tobytes())
                new.append(index.new)
                index.new = []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(new, pa.list_(pa.string())), pa.array(anew, pa.bool_())], names=["k", "words", "new", "anew"])

    def joined(batches):
        known = _Ids()
        for batch in batches:
            ids, counts = [], []
            for words, got, new, anew in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if anew:
                    known = _Ids()
                merged = [merge_heap(w.encode("latin-1"), shared.value) if g is None else g for g, w in zip(got, new)]
                known.add(np.array([len(m) for m in merged], np.int64), np.array([i for m in merged for i in m], np.uint32))
                own = known.of(np.frombuffer(words, np.int64))
                counts.append(len(own))
                ids.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["k", "n_tokens", "ids"])

    def folded(words: Column) -> Column:
        fold = lambda w, r: F.when(F.length(w) > FOLD_BYTES, F.lit(None)).otherwise(fold_merges(w, r, buckets))
        return F.element_at(F.transform(F.array(rank_literal(ranks, buckets)), lambda r: F.transform(words, lambda w: fold(w, r))), 1)

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .transform(in_batches, numbered, f"k {kind}, words binary, new array<string>, anew boolean")
        .select("k", "words", folded(F.col("new")).alias("new_ids"), "new", "anew")
        .transform(in_batches, joined, f"k {kind}, n_tokens long, ids binary")
        .withColumnRenamed("k", key)
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes of ids: the concatenation of their pieces. Null ids decode to nothing."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    at = encoded.columns.index(ids)

    def run(batches):
        piece = shared.value.__getitem__
        for batch in batches:
            out = [b"".join(map(piece, np.frombuffer(x or b"", np.uint32).tolist())) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, into])

    return encoded.transform(in_batches, run, T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())]))

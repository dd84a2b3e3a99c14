"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

The automaton of all items is built once; the words of each document stream through it and the length
of the longest match that ends at each word is tracked. A word is hit if it lies in a match of
``window`` words (or in a whole item of fewer words). Spans of hit words are removed if the document's
share of hit words reaches the coverage limit of a span, or always with limit 0; a document whose
share reaches ``drop_coverage`` goes as a whole.

Items are dealt to blocks of about BLOCK_WORDS words, and a longer item is cut into pieces that overlap by a
window less one word. One block at a time comes to the driver, becomes an automaton that is broadcast, and
all documents stream through it; with several blocks the spans found so far are written between them. So
what the driver and the executors hold is bounded however many items there are, and results do not depend
on blocks: spans of all of them are merged before anything is judged or cut.

Edge cases: null and empty texts have no words, no hits and are not contaminated; items without words
and items without an id match nothing (the latter are not counted); repeated items count once by id;
repeated documents give repeated rows; very long texts and items are whole; ties do not occur; an empty
benchmark hits nothing and an empty table of documents gives an empty one; other columns are ignored, or
kept by ``remove_spans``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, in_batches, written

WINDOW = 13
BLOCK_WORDS = 200_000  # an automaton of so many takes about 130 MB in each Python worker
#: A-Z to a-z; every other byte that is no part of a word to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and all that is not ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with what ends a window at each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.window = [-1], [0], window
        coded = []
        for item, words in items:
            coded.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
            last = 0
            for c in coded[-1][1]:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}  # of states whose string of `window` words lies in an item
        self.short: dict[int, list[tuple[int, str]]] = {}  # of states that are a whole shorter item
        for item, codes in coded:
            v = n = 0
            for c in codes:
                v, n = self.step(v, n, c)
                if n == window:
                    self.items.setdefault(v, set()).add(item)
            if 0 < len(codes) < window:
                self.short.setdefault(v, []).append((len(codes), item))
        #: The nearest state at or above on the path of links that is a whole shorter item.
        self.output = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.output[v] = v if v in self.short else self.output[self.link[v]] if v else -1

    @classmethod
    def of(cls, state: dict) -> SuffixAutomaton:
        """The automaton of plain state, which is what travels to executors."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """State and length of the longest match, of `window` words at most, after one more word."""
        nxt, link, length = self.next, self.link, self.len
        while v and c not in nxt[v]:
            v = link[v]
            n = length[v]
        if c in nxt[v]:
            v, n = nxt[v][c], n + 1
            if n > self.window:
                n = self.window
            while length[link[v]] >= n:
                v = link[v]
        return v, n

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans [start, end) of hit words, merged, and the items found."""
        nxt, link, length, window, output = self.next, self.link, self.len, self.window, self.output
        spans: list[list[int]] = []
        found: set[str] = set()
        v = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                v = n = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c not in nxt[v]:
                n = 0
                continue
            v, n = nxt[v][c], n + 1
            if n > window:
                n = window
            while length[link[v]] >= n:
                v = link[v]
            hit = 0
            if n == window:
                hit = n
                found |= self.items.get(v, set())
            u = output[v]
            while u > 0:
                for size, item in self.short[u]:
                    if size <= n:
                        hit = max(hit, size)
                        found.add(item)
                u = output[link[u]]
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, found


def pieces(words: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """The words in pieces of at most so many (and at least a window), in which each window lies whole."""
    most = max(most, window)
    if len(words) <= most:
        return [words] if words else []
    return [words[i : i + most] for i in range(0, len(words) - window + 1, most - window + 1)]


def blocks(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> tuple[int, Callable[[int], SuffixAutomaton]]:
    """How many blocks all items make, and a function that builds the automaton of one."""

    def cut(batches):
        for b in batches:
            out = [(i, k, len(x), b" ".join(x)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, x in enumerate(pieces(words_of(t), window, block_words))]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["item", "piece", "n", "words"])

    named = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("t")).where("item is not null")
    items = written(named.transform(in_batches, cut, "item string, piece int, n long, words binary"), "items")
    n = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    dealt = F.pmod(F.xxhash64("item", "piece", "words"), F.lit(n))
    return n, lambda i: SuffixAutomaton([(r.item, r.words.split()) for r in items.where(dealt == i).select("item", "words").toLocalIterator()], window)


def _through(df: DataFrame, benchmark: DataFrame, window: int, block_words: int, step: Callable[..., tuple[Callable, StructType]]) -> DataFrame:
    """df through the automaton of one block after another; step gives the function of a pass and its schema, told whether it is the last."""
    n, build = blocks(benchmark, window, block_words=block_words)
    for i in range(n):
        shared, last = df.sparkSession.sparkContext.broadcast(vars(build(i))), i == n - 1
        out = df.transform(in_batches, *step(shared, last))
        if last:
            return out
        out = written(out, "spans")
        shared.destroy()
        if i:
            discard(df)
        df = out
    return df


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, n_words, spans (word positions of hits, merged) and items (sorted as strings) of each document."""
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    df = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *none)

    def step(shared, _):
        def run(batches):
            match = SuffixAutomaton.of(shared.value).match
            for b in batches:
                n, spans, items = [], [], []
                for t, old, had in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    words = words_of(t)
                    got, found = match(words)
                    n.append(len(words))
                    spans.append(_merged(old + got) if old else got)
                    items.append(sorted(found.union(had)))
                told = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *told], names=["k", "t", "n_words", "spans", "items"])

        return run, df.schema

    return _through(df, benchmark, window, block_words, step).select(F.col("k").alias(key), "n_words", "spans", "items")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _offsets(data: bytes) -> list[tuple[int, int]]:
    out, plain, at = [], data.translate(_TABLE), 0
    for w in plain.split():
        at = plain.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_coverage: float = 0.5, span_coverage: float = 0.0, text: str = "text", n_chars: str = "n_chars", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs without hit spans (where hits make up span_coverage of the words at least) and without documents of which hits make up drop_coverage. All columns stay; n_chars, if there, is counted anew.
    The spans of all blocks are found in the text as it came and merged; the last block's task judges and cuts once."""
    at = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else -1
    held, names = "spans", {c.lower() for c in docs.columns}
    while held in names:
        held += "_"
    first = docs.withColumn(held, F.array().cast("array<array<int>>"))

    def step(shared, last):
        def run(batches):
            match = SuffixAutomaton.of(shared.value).match
            for b in batches:
                *columns, had = b.columns
                texts, found, keep = columns[at].to_pylist(), [], []
                for row, (t, old) in enumerate(zip(texts, had.to_pylist())):
                    words = words_of(t)
                    got, _ = match(words)
                    spans = _merged(old + got) if old else got
                    found.append(spans)
                    hit = sum(e - s for s, e in spans)
                    keep.append(not hit or hit < drop_coverage * len(words))
                    if last and hit and keep[-1] and hit >= span_coverage * len(words):
                        data = t.encode("utf-8", "surrogatepass")
                        where, rest, done = _offsets(data), [], 0
                        for s, e in spans:
                            rest.append(data[done : where[s][0]])
                            done = where[e - 1][1]
                        texts[row] = b"".join([*rest, data[done:]]).decode("utf-8", "surrogatepass")
                if not last:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, b.schema.field(len(columns)).type)], schema=b.schema)
                    continue
                schema = pa.schema(list(b.schema)[:-1])
                columns[at] = pa.array(texts, schema.field(at).type)
                if count >= 0:
                    columns[count] = pa.array([None if t is None else len(t) for t in texts]).cast(schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(keep, pa.bool_()))

        return run, docs.schema if last else first.schema

    return _through(first, benchmark, window, block_words, step)

"""Language ID with language-bitmask n-gram filters.

For each language the commonest letter n-grams of its texts go into a Bloom filter; the filters are
bit-sliced: position p of all of them is one integer with a bit for each language, so one lookup of
each hash and a bitwise AND return all languages that contain an n-gram. A text's n-grams are counted
for each language (popcounts), the counts are corrected for the filter's share of false positives, and
the language with the largest corrected share decides.

Learned from labelled rows that are not held out; a language of more than ``max_rows`` of them gives
about that many, taken by hash.

``keep_known`` weighs longer n-grams more (short ones are shared by most languages of a script) and asks
for a score of MARGIN times the one that all but a part QUANTILE of labelled rows reach, by filters that
were learned from the others.

Edge cases: null texts and texts without letters are ``und`` with score 0; ties go to the first
language in alphabetical order; with no labelled text at all every text is ``und``; rows with a null
language are not learned from; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CACHE, held_out, in_batches, mix, runs

ORDERS = (2, 3, 4)
MAX_ROWS = 3_000
KEEP = 6_000  # n-grams of each language
HASHES = 4
WEIGHTS = (1, 2, 4)  # of n-grams by order, in keep_known
QUANTILE = 0.1
MARGIN = 0.7
RUN = 500_000  # characters whose words are looked up at once
LEAST = 0.25  # where there are no rows to derive it from
_NUMBERS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) in ("Nl", "No"))  # word characters, but no letters or digits
_ALNUM, _LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMBERS}]+")


def letters(texts: list[str | None]) -> list[list[str]]:
    """Runs of letters (Unicode category L) of texts in lower case. The short class, which has other numbers than digits too,
    is ten times as fast; the few words that have any are split again."""
    found = [_ALNUM.findall(t.lower()) if t else [] for t in texts]
    odd = {w: _LETTERS.findall(w) for w in {w for f in found for w in f} if not w.isalpha()}
    return [[x for w in f for x in odd.get(w, (w,))] if not odd.keys().isdisjoint(f) else f for f in found] if odd else found


def gram_hashes(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes (62 bits) of all letter n-grams of the words, with a mark at either end of a word, and
    which word each is of."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], letters
    for n in range(2, max(ORDERS) + 1):
        h = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[n - 1 :])
        if n in ORDERS:
            same = row[n - 1 :] == row[: len(h)]
            out.append(((h[same] >> np.uint64(2)).astype(np.int64), row[: len(h)][same]))
    return out


def slots(h: np.ndarray, size: int) -> np.ndarray:
    """Positions of hashes in filters of a size that is a power of two, a row for each hash function."""
    a, b = h & 0x7FFFFFFF, (h >> 31) | 1
    return np.stack([(a + i * b) & (size - 1) for i in range(HASHES)])


class Filters:
    """The bit-sliced filters: languages in order, masks by position, false-positive share by language."""

    def __init__(self, by_language: dict[str, list[int]]) -> None:
        self.languages, self.least = sorted(by_language), LEAST
        most = max((len(v) for v in by_language.values()), default=0)
        self.size = max(64, 1 << (16 * most).bit_length())
        lanes = (len(self.languages) + 63) // 64 or 1
        self.masks = np.zeros((lanes, self.size), np.uint64)
        self.false = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            at = slots(np.array(by_language[name], np.int64), self.size)
            self.masks[k // 64, at.ravel()] |= np.uint64(1 << (k % 64))
            self.false[k] = (len(np.unique(at)) / self.size) ** HASHES

    @classmethod
    def of(cls, state: dict) -> Filters:
        """The filters of plain state, which is what travels to executors."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def counts(self, words: list[str], weights: tuple[int, ...] | None = None) -> np.ndarray:
        """For each word: n-grams in each language's filter, then n-grams in all; each counts as the weight of its order."""
        out = np.zeros((len(words), len(self.languages) + 1), np.int64)
        for (h, row), weight in zip(gram_hashes(words), weights or (1,) * len(ORDERS)):
            at = slots(h, self.size)
            for lane, masks in enumerate(self.masks):
                hit = masks[at[0]]
                for p in at[1:]:
                    hit &= masks[p]
                for k in range(lane * 64, min(len(self.languages), lane * 64 + 64)):
                    out[:, k] += weight * np.bincount(row[(hit >> np.uint64(k % 64)) & np.uint64(1) > 0], minlength=len(words))
            out[:, -1] += weight * np.bincount(row, minlength=len(words))
        return out

    def decide(self, counts: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each text from its counts."""
        n = counts[:, -1:].astype(float)
        share = (counts[:, :-1] - n * self.false) / (np.maximum(n, 1) * (1 - self.false))
        share = np.clip(share, 0, 1)
        if not self.languages:
            return [("und", 0.0)] * len(counts)
        best = share.argmax(axis=1)
        return [(self.languages[b], float(s[b])) if t else ("und", 0.0) for b, s, t in zip(best, share, n[:, 0])]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, keep: int = KEEP, calibrated: bool = True) -> Filters:
    """Filters of the labelled rows; calibrated, with the least score of texts in a known language."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out("k"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Filters({})
    part = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, max_rows / n))])
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.element_at(part, F.col("lang")) * (1 << 20))
    filters = _learned(sample, list(sizes), keep)
    if calibrated:
        fold = F.pmod(F.xxhash64(F.lit("fold"), "k"), F.lit(5)) == 0
        scored = _scored(sample.where(fold), _learned(sample.where(~fold), list(sizes), keep), WEIGHTS)
        low = scored.where("lang_pred <> 'und'").agg(F.percentile_approx("score", QUANTILE)).first()[0]
        filters.least = LEAST if low is None else MARGIN * low
    return filters


def _learned(sample: DataFrame, languages: list[str], keep: int) -> Filters:
    """Filters of all rows (k, t, lang)."""

    def count(batches):
        words: dict[str, dict[str, int]] = {}
        for b in batches:
            for found, name in zip(letters(b.column(1).to_pylist()), b.column(2).to_pylist()):
                own = words.setdefault(name, {})
                for w in found:
                    own[w] = own.get(w, 0) + 1
            if sum(map(len, words.values())) > WORD_CACHE:
                yield from told(words)
                words = {}
        yield from told(words)

    def told(words):
        for name, own in words.items():
            if own:
                times = np.fromiter(own.values(), np.int64, len(own))
                found = gram_hashes(list(own))
                g, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
                n = np.bincount(at, times[np.concatenate([row for _, row in found])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "g", "n"])

    totals = sample.transform(in_batches, count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))
    top = totals.withColumn("rank", rank).where(F.col("rank") <= keep)  # keep rows for each language
    by: dict[str, list[int]] = {name: [] for name in languages}
    for r in top.select("lang", "g").collect():
        by[r["lang"]].append(r["g"])
    return Filters(by)


def counted(filters: Filters, texts: list[str | None], weights: tuple[int, ...] | None = None) -> np.ndarray:
    """Counts of whole texts: those of the distinct words of a run of texts, summed by text."""
    return np.concatenate([np.zeros((0, len(filters.languages) + 1), np.int64), *(_counted(filters, run, weights) for run in runs(texts))])


def _counted(filters: Filters, texts: list[str | None], weights: tuple[int, ...] | None) -> np.ndarray:
    found = letters(texts)
    sizes = np.array([len(f) for f in found], np.int64)
    out = np.zeros((len(texts), len(filters.languages) + 1), np.int64)
    if sizes.any():
        at: dict[str, int] = {}
        words = np.fromiter((at.setdefault(w, len(at)) for f in found for w in f), np.int64, int(sizes.sum()))
        rows = filters.counts(list(at), weights)
        full = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(out.shape[1]):
            out[full, k] = np.add.reduceat(rows[words, k], starts)
    return out


def _scored(texts: DataFrame, filters: Filters, weights: tuple[int, ...] | None = None) -> DataFrame:
    """k, lang_pred and score of rows (k, t ...)."""
    shared = texts.sparkSession.sparkContext.broadcast(vars(filters))  # KEEP n-grams of each language

    def run(batches):
        known = Filters.of(shared.value)
        for b in batches:
            got = known.decide(counted(known, b.column(1).to_pylist(), weights))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["k", "lang_pred", "score"])

    kind = texts.schema["k"].dataType.simpleString()
    return texts.select("k", "t").transform(in_batches, run, f"k {kind}, lang_pred string, score double")


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of each whole text."""
    return _scored(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), filters).withColumnRenamed("k", key)


def keep_known(docs: DataFrame, filters: Filters, least: float | None = None, text: str = "text") -> DataFrame:
    """docs without those of no known language (``und``) or of a score under ``least``, by default that of the filters; all columns stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(vars(filters)), docs.columns.index(text)
    least = filters.least if least is None else least

    def run(batches):
        known = Filters.of(shared.value)
        for b in batches:
            got = known.decide(counted(known, b.column(at).to_pylist(), WEIGHTS))
            yield b.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))

    return docs.transform(in_batches, run, docs.schema)

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, word pairs and pairs with one or two words between them in
a whole text. Weights are learned with per-coordinate rates and L1 sparsity in one pass order that
depends on ids alone, from a bounded sample of labelled rows (``max_rows``, the ones of least hash, and
of these, in that order, those that fit into ``max_features`` in all, each with all of its features);
the few non-zero weights are broadcast, and every whole text is scored without a shuffle.

Edge cases: null and empty texts have no features and get the bias' score; rows without a label, or
labelled both ways, are not learned from; with no labels at all every score is 0.5; repeated rows give
repeated scores; very long texts are scored whole; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, held_out, in_batches, mix, runs

BITS = 20
MAX_ROWS = 16_000
MAX_FEATURES = 60_000_000  # of four bytes, in the one task that learns
WORD = re.compile(r"[^\W_]+")


def features(texts: list[str | None], hashes: WordHash, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (1 and up) of all texts, and which text each is of; with repeats."""
    shift = np.uint64(64 - bits)
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    h = np.fromiter((x for w in found for x in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    out, rows = [mix(h) >> shift], [row]
    for gap in (1, 2, 3):
        same = row[gap:] == row[:-gap]
        pair = h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(2 * gap + 1)
        out.append((mix(pair) >> shift)[same])
        rows.append(row[gap:][same])
    return np.concatenate(out).astype(np.int64) + 1, np.concatenate(rows)


class Ftrl:
    """FTRL-proximal state; coordinate 0 is the bias and has no L1 penalty."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == 0, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, i: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, epochs: int = 8, bits: int = BITS, max_features: int = MAX_FEATURES) -> list[tuple[int, float]]:
    """Non-zero weights, learned from labelled rows that are not held out."""
    sample = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k"))
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1")
        .orderBy(F.xxhash64("k"), "k").limit(max_rows).select("k", "y")
    )
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")  # max_rows rows

    def extract(batches):
        hashes = WordHash()
        for b in batches:
            out = []
            for texts in runs(b.column(1).to_pylist()):
                i, row = features(texts, hashes, bits)
                both = np.unique(row * (1 << 32) + i)
                at = np.searchsorted(both, np.arange(len(texts) + 1) << 32)
                both = (both & 0xFFFFFFFF).astype(np.int32)
                out += [both[s:e].tobytes() for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["k", "y", "f"])

    def train(batches):
        model, seen, room = Ftrl((1 << bits) + 1), [], max_features
        for b in batches:
            for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if 4 * room >= len(f):
                    room -= len(f) // 4
                    seen.append((f, y))
        for _ in range(epochs):
            for f, y in seen:
                model.learn(np.concatenate([[0], np.frombuffer(f, np.int32)]), y)
        used = np.unique(np.concatenate([[0], np.flatnonzero(np.abs(model.z) > model.l1)]))
        w = model.weights(used)
        yield pa.RecordBatch.from_arrays([pa.array(used[w != 0], pa.int64()), pa.array(w[w != 0], pa.float64())], names=["i", "w"])

    one = rows.select("k", "y", "t").select("k", "t", "y").transform(in_batches, extract, f"k {docs.schema[key].dataType.simpleString()}, y int, f binary")
    ordered = one.withColumn("h", F.xxhash64("k")).repartition(1).sortWithinPartitions("h", "k", "f").select("f", "y")
    return sorted((r.i, r.w) for r in ordered.transform(in_batches, train, "i long, w double").collect())


def score(docs: DataFrame, weights: list[tuple[int, float]], key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """key and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # non-zero weights: fewer than 2**bits

    def run(batches):
        w = np.zeros((1 << bits) + 1)
        for i, x in shared.value:
            w[i] = x
        hashes = WordHash()
        for b in batches:
            total = []
            for texts in runs(b.column(1).to_pylist()):
                i, row = features(texts, hashes, bits)
                on = w[i] != 0
                both = np.unique(row[on] * (1 << 32) + i[on])
                total.append(w[0] + np.bincount(both >> 32, w[both & 0xFFFFFFFF], len(texts)))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *total]), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(in_batches, run, f"k {kind}, score double").withColumnRenamed("k", key)

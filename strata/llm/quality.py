"""Quality by importance resampling.

Two generative models over hashed n-grams (tokens and token pairs, case kept): one of the target (texts
labelled good), one of all raw texts. A text's log importance weight is the sum over its n-grams of the
log ratio of the two. With Gumbel noise, a function of the row's id, added to the weights, the k largest
are a sample without replacement in proportion to the weights; k is the raw rows times the share of
labelled rows that are good, plus ``slack``.

Counts of the raw model cover all texts. The k-th largest is found by counting digits of the sortable
form of the perturbed weights, 16 bits a round, so no sort meets in one task.

Edge cases: null and empty texts have no n-grams and log weight 0; rows with equal perturbed weights at
the k-th place (repeated rows) are all kept; without labels nothing is rejected; an empty table gives an
empty one; other columns are ignored, or kept by ``keep_sampled``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, held_out, in_batches, mix, runs, written

BITS = 16
MAX_ROWS = 16_000
SMOOTH = 1.0
SLACK = 0.005
SEED = 7
TOKEN = re.compile(r"\w+|[^\w\s]+")


def ngrams(texts: list[str | None], hashes: WordHash, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and which text each is of."""
    shift = np.uint64(64 - bits)
    found = [TOKEN.findall(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    h = np.fromiter((x for w in found for x in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    same = row[1:] == row[:-1]
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(3)) >> shift
    return np.concatenate([mix(h) >> shift, pairs[same]]).astype(np.int64), np.concatenate([row, row[1:][same]])


def counts(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Counts of each bucket over all rows of the one column; 2**bits of them reach the driver."""

    def run(batches):
        sums, hashes = np.zeros(1 << bits, np.int64), WordHash()
        for b in batches:
            for part in runs(b.column(0).to_pylist()):
                sums += np.bincount(ngrams(part, hashes, bits)[0], minlength=1 << bits)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["b", "n"])

    out = np.zeros(1 << bits)
    for b in texts.transform(in_batches, run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toLocalIterator():
        out[b["b"]] = b["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log of p(bucket) in the target over p(bucket) in the raw texts."""
    p = (target + smooth) / (target.sum() + smooth * len(target))
    q = (raw + smooth) / (raw.sum() + smooth * len(raw))
    return np.log(p) - np.log(q)


def gumbel(keys: list, seed: int = SEED) -> np.ndarray:
    """Gumbel noise, a function of each key."""
    u = np.array([(xxhash.xxh64_intdigest(str(k).encode(), seed=seed) >> 11) + 0.5 for k in keys]) / 2**53
    return -np.log(-np.log(u))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Log ratios, and the share of labelled rows that are good. At most max_rows labelled rows (of least hash) are read; raw counts cover all rows."""
    marked = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k"))
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("k", "y")
    )
    good, n = marked.agg(F.sum("y"), F.count("*")).first()
    if not n:
        return np.zeros(1 << BITS), 1.0
    sample = marked.where("y = 1").orderBy(F.xxhash64("k"), "k").limit(max_rows).select("k")
    target = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k", "left_semi").select("t")  # max_rows rows
    return log_ratio(counts(target), counts(docs.select(F.col(text)))), (good or 0) / n


def _perturbed(keys: list, texts: list[str | None], ratio: np.ndarray, hashes: WordHash, seed: int) -> tuple[np.ndarray, np.ndarray]:
    weight = [np.zeros(0)]
    for run in runs(texts):
        i, row = ngrams(run, hashes)
        weight.append(np.bincount(row, ratio[i], len(run)))
    weight = np.concatenate(weight)
    return weight, weight + gumbel(keys, seed)


def weigh(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, log_weight and perturbed (with noise) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 2**BITS numbers

    def run(batches):
        hashes = WordHash()
        for b in batches:
            w, p = _perturbed(b.column(0).to_pylist(), b.column(1).to_pylist(), shared.value, hashes, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64()), pa.array(p, pa.float64())], names=["k", "log_weight", "perturbed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(in_batches, run, f"k {kind}, log_weight double, perturbed double").withColumnRenamed("k", key)


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a column of doubles, exactly; None if there are fewer. 65,536 counts a round reach the driver."""
    if k <= 0:
        return float("inf")

    def digits(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.int64)
            x = np.where(x < 0, ~x, x | np.int64(-(2**63))).view(np.uint64)  # sorts as the doubles do
            yield pa.RecordBatch.from_arrays([pa.array(((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int32), pa.int32()) for s in (48, 32, 16, 0)], names=["d0", "d1", "d2", "d3"])

    keys = values.select(F.col(column).cast("double")).where(F.col(column).isNotNull()).transform(in_batches, digits, "d0 int, d1 int, d2 int, d3 int")
    got = 0
    for r in range(4):
        for d, n in sorted(((x[0], x[1]) for x in keys.groupBy(f"d{r}").count().collect()), reverse=True):
            if n >= k:
                got, keys = got << 16 | d, keys.where(F.col(f"d{r}") == d)
                break
            k -= n
        else:
            return None
    got = got ^ (1 << 63) if got >> 63 else ~got & 0xFFFFFFFFFFFFFFFF
    return float(np.array([got], np.uint64).view(np.float64)[0])


def least_kept(scored: DataFrame, share: float) -> float:
    """The least perturbed weight of the sample: the k-th largest, with k the rows times the share, rounded up."""
    least = kth_largest(scored, "perturbed", int(np.ceil(scored.count() * min(1.0, share))))
    return float("-inf") if least is None else least


def sample(docs: DataFrame, labels: DataFrame, slack: float = SLACK, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, log_weight, perturbed and kept of each row."""
    ratio, share = fit(docs, labels, key=key, text=text)
    scored = written(weigh(docs, ratio, key, text, seed), "weights")
    return scored.withColumn("kept", F.col("perturbed") >= F.lit(least_kept(scored, share + slack)))


def keep_sampled(docs: DataFrame, labels: DataFrame, slack: float = SLACK, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of docs that are sampled; all columns stay. Rows are written with their weights, so texts are read twice in all and never shuffled."""
    ratio, share = fit(docs, labels, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    k, at, weight = docs.columns.index(key), docs.columns.index(text), "perturbed"
    while weight in {c.lower() for c in docs.columns}:
        weight += "_"

    def run(batches):
        hashes = WordHash()
        for b in batches:
            p = _perturbed(b.column(k).to_pylist(), b.column(at).to_pylist(), shared.value, hashes, seed)[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, weight])

    scored = written(docs.transform(in_batches, run, T.StructType([*docs.schema.fields, T.StructField(weight, T.DoubleType())])), "weighed")
    return scored.where(F.col(weight) >= F.lit(least_kept(scored.select(F.col(weight).alias("perturbed")), share + slack))).drop(weight)

"""Tables, written intermediates and hashing shared by the operators."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

WORD_CACHE = 150_000  # words that a task remembers before it starts anew; bounds its memory
BATCH_BYTES = "2m"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder. Cuts lineage; survives the loss of any executor. Spark deletes the shuffle
    files that it was made from when it is written, as nothing reads them again. ``discard`` deletes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_BYTES or so (or one row), however long the texts are: what the JVM
    and Python hold at once does not grow with the texts of 10,000 rows. A task that ends gives its memory back, as
    its worker stays for others."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def freed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where there is no such library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(freed, schema)


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 when divided by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def runs(texts: list[str | None], chars: int = 1_000_000):
    """The texts in runs of about so many characters, or of one longer text: what is worked on at once stays small."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t or "") > chars:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t or "")
    if run:
        yield run


class WordHash(dict):
    """64-bit hashes of words, remembered up to WORD_CACHE of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))

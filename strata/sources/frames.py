"""A record log: frames of magic byte, head, CRC-32 of the head, then a body whose length the head tells.

Head: key u32, body length u32, little-endian; the CRC covers the head only. A frame whose magic or CRC is
wrong is skipped up to the next magic byte after its first byte; an incomplete frame at the end stops.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = 0xAB
_FRAME, _SIZE = "<BIII", 13
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PIECE = 1024 * 1024
LONGEST = 2**31 - 1  # bytes of a log that is read whole


def _u32(c: Column) -> Column:
    """Four bytes, little-endian, of a number."""
    text = F.lpad(F.hex(c), 8, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)]))


def frame(key: Column, body: Column) -> Column:
    head = F.concat(_u32(key.cast("long")), _u32(F.octet_length(body).cast("long")))
    return F.concat(F.unhex(F.lit("AB")), head, _u32(F.crc32(head)), body)


def parse(data: bytes) -> list[tuple[int, int, int, str]]:
    """(offset, key, length, status) of frames; status is ok, magic, crc or need_more."""
    out, at, end = [], 0, len(data)
    while at < end:
        if end - at < _SIZE:
            out.append((at, 0, 0, "need_more"))
            break
        magic, key, size, crc = struct.unpack_from(_FRAME, data, at)
        bad = "magic" if magic != MAGIC else "crc" if zlib.crc32(data[at + 1 : at + 9]) != crc else ""
        if bad:
            out.append((at, 0, 0, bad))
            skip = data.find(bytes([MAGIC]), at + 1)
            at = skip if skip > 0 else end
            continue
        if at + _SIZE + size > end:
            out.append((at, key, size, "need_more"))
            break
        out.append((at, key, size, "ok"))
        at += _SIZE + size
    return out


def scan(logs: DataFrame, data: str = "data", log: str = "log") -> DataFrame:
    """log, offset, key, len and status of each frame of each log (a row of bytes)."""

    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse(d or b"")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["log", "offset", "key", "len", "status"])

    return logs.select(F.col(log).cast("long"), F.col(data)).mapInArrow(run, "log long, offset long, key long, len long, status string")


def append(frames: DataFrame, log: str, order: str, frame_col: str = "frame") -> DataFrame:
    """Logs as rows: the frames of each log, one after another. A group is one log file, whose size its writer bounds."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(frame_col).cast("string").alias("frame"))))
    joined = F.array_join(F.transform("rows", lambda x: x["frame"]), "").cast("binary")  # strings of any bytes
    return frames.groupBy(F.col(log).alias("log")).agg(rows.alias("rows")).select("log", joined.alias("data"))


def write_files(logs: DataFrame, path: str) -> None:
    """Each log (log, data) as a file in a folder of its own. The writer ends a file by a line feed, which is no frame.
    Spark deletes the shuffle files that the logs were made from when they are written."""
    spark = logs.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        logs.select("log", F.col("data").cast("string").alias("value")).write.partitionBy("log").text(path)
    finally:
        spark.conf.set(CLEANUP, before)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """log, data and size of the log files under a path, whole. A file's size is bounded by its writer's rotation."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("log").cast("long").alias("log"), F.col("content").alias("data"), F.col("length").alias("size"))


def fetch(positions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Adds value, the bytes at (wal_id, offset, len); null where they run past the end or there is no such log.

    Logs are cut into pieces of PIECE bytes, and a position meets the pieces that it lies in. Its bytes are cut out as
    they meet, before rows are sorted or sent again, so neither a log nor a piece is kept for each of its positions.
    Only positions that lie in several pieces are sent once more, to be put together."""
    size = F.octet_length("data")
    pieces = payloads.select("log", "data", size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor(size / PIECE).cast("int"))).alias("piece"))
    pieces = pieces.select("log", "size", F.col("piece").cast("long").alias("piece"), F.substring("data", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("bytes"))
    offset, length = F.col("row.offset").cast("long"), F.col("row.len").cast("long")
    inside = offset.between(0, LONGEST) & length.between(0, LONGEST)
    first, last = F.when(inside, F.floor(offset / PIECE)), F.when(inside, F.floor((offset + F.greatest(length, F.lit(1)) - 1) / PIECE))
    asked = positions.select(F.struct("*").alias("row")).select("row", first.alias("first"), last.alias("last"))
    several = F.coalesce(F.col("first") < F.col("last"), F.lit(False))

    def cut(asked: DataFrame) -> DataFrame:
        """What a position has of its piece, and the log's size; null if there is no such piece."""
        start = F.greatest(offset - F.col("at") * PIECE, F.lit(0))
        end = F.least(offset + length - F.col("at") * PIECE, F.lit(PIECE))
        met = asked.join(pieces, (F.col("row.wal_id") == F.col("log")) & (F.col("at") == F.col("piece")), "left")
        return met.select(*asked.columns, "size", F.substring("bytes", start.cast("int") + 1, (end - start).cast("int")).alias("part"))

    whole = F.col("size") - length >= offset
    short = cut(asked.where(~several).select("row", F.col("first").alias("at"))).select("row.*", F.when(whole, F.col("part")).alias("value"))
    numbered = asked.where(several).select("row", "first", "last", F.monotonically_increasing_id().alias("id"))  # before they are exploded
    spread = numbered.select("row", "id", F.explode(F.sequence("first", "last")).alias("at"))
    # Dealt out by id first: a partial aggregate would sort whole pieces, as it cuts only when it reads its sorted rows.
    part = F.struct("at", F.col("part").cast("string").alias("part"))
    parts = cut(spread).repartition("id").groupBy("id").agg(F.first("row").alias("row"), F.min("size").alias("size"), F.array_sort(F.collect_list(part)).alias("parts"))
    value = F.array_join(F.transform("parts", lambda x: x["part"]), "").cast("binary")
    return short.unionAll(parts.select("row.*", F.when(whole, value).alias("value")))

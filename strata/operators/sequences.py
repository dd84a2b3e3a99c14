"""Queries on a non-decreasing sequence (pos, val): access, successor, predecessor, ranges, chunks.

Successors of many targets are found in one table of elements and targets that is sorted by ranges: in a target's own
file by a window, else the first element of the next file that has any; only one row for each file meets in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elias_fano
from .versions import sorted_table


def next_ge(seq: DataFrame, targets: DataFrame) -> DataFrame:
    """t, pos and val of the first element at or after each target (column t); no row beyond the end."""
    return _near(seq, targets, forward=True)


def prev_lt(seq: DataFrame, targets: DataFrame) -> DataFrame:
    """t, pos and val of the last element before each target."""
    return _near(seq, targets, forward=False)


def _near(seq: DataFrame, targets: DataFrame, forward: bool) -> DataFrame:
    element = "struct<val:bigint,pos:bigint>"
    one = seq.groupBy("val").agg((F.min if forward else F.max)("pos").alias("pos")).select("val", F.lit(1).alias("rank"), F.struct("val", "pos").alias("e"))
    asked = targets.select(F.col("t").cast("long").alias("val")).distinct().select("val", F.lit(0).alias("rank"), F.lit(None).cast(element).alias("e"))
    # a target is right before the element of its own value: what follows is at or after it, what precedes is before it
    rows, file, place = sorted_table(one.unionByName(asked), ("val", "rank"))
    held = rows.select("*", file.alias("file"), place.alias("place"))
    order = F.desc if forward else F.asc
    near = F.last("e", ignorenulls=True).over(Window.partitionBy("file").orderBy(order("place")).rowsBetween(Window.unboundedPreceding, -1))
    ends = held.groupBy("file").agg((F.min_by if forward else F.max_by)("e", F.when(F.col("e").isNotNull(), F.col("place"))).alias("end"))
    beyond = F.last("end", ignorenulls=True).over(Window.orderBy(order("file")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    found = held.withColumn("near", near).where("rank = 0").join(F.broadcast(ends.select("file", beyond.alias("beyond"))), "file")
    out = found.select(F.col("val").alias("t"), F.coalesce("near", "beyond").alias("e"))
    return out.where("e is not null").select("t", F.col("e.pos").alias("pos"), F.col("e.val").alias("val"))


def chunks(seq: DataFrame, size: int = elias_fano.CHUNK) -> DataFrame:
    """chunk, n, min and max: the zone map that skips chunks."""
    return seq.groupBy(F.expr(f"pos div {size}").alias("chunk")).agg(F.count("*").alias("n"), F.min("val").alias("min"), F.max("val").alias("max"))


def pack(seq: DataFrame, size: int = elias_fano.CHUNK) -> DataFrame:
    """chunk, first_pos, n, max and blob: each chunk of the sequence coded by Elias-Fano, and the upper level of maxima. A
    group is one chunk."""

    def run(table: pa.Table) -> pa.Table:
        pos, val = table.column("pos").to_numpy(), table.column("val").to_numpy()
        order = np.argsort(pos)
        blob = elias_fano.encode(val[order].astype(np.uint64))
        return pa.table({"chunk": [int(pos.min()) // size], "first_pos": [int(pos.min())], "n": [len(pos)], "max": [int(val.max())], "blob": pa.array([blob], pa.binary())})

    return seq.select("pos", "val", F.expr(f"pos div {size}").alias("chunk")).groupBy("chunk").applyInArrow(run, "chunk long, first_pos long, n long, max long, blob binary")


def unpack(packed: DataFrame) -> DataFrame:
    """pos and val of packed chunks."""

    def run(batches):
        for b in batches:
            for first, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = elias_fano.decode(blob)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(v))), pa.array(v.astype(np.int64))], names=["pos", "val"])

    return packed.select("first_pos", "blob").mapInArrow(run, "pos long, val long")


ASKED = 4096  # questions to one chunk that are answered by one opening of its blob


def _open(asked: DataFrame, packed: DataFrame, find) -> DataFrame:
    """t, pos and val: the answers to questions (t, chunk) by the blob of their chunk. Questions to a chunk are put
    together, about ASKED at a time, so that a blob is opened for many and no chunk's questions meet in one row."""
    part = F.pmod(F.xxhash64("t"), F.greatest(F.lit(1), F.ceil(F.col("many") / ASKED)))
    many = asked.groupBy("chunk").agg(F.count("*").alias("many"))
    grouped = asked.join(many, "chunk").groupBy("chunk", part.alias("part")).agg(F.collect_list("t").alias("ts"))

    def run(batches):
        for b in batches:
            t, pos, val = [], [], []
            for ts, first, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                values = elias_fano.decode(blob).astype(np.int64)
                ts, at = find(np.array(ts, np.int64), first, values)
                t.append(ts)
                pos.append(first + at)
                val.append(values[at])
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (t, pos, val)], names=["t", "pos", "val"])

    return grouped.join(packed, "chunk").select("ts", "first_pos", "blob").mapInArrow(run, "t long, pos long, val long")


def packed_next_ge(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """t, pos and val of the first element at or after each target, by the chunks' maxima and then the one blob that it is in."""
    upper = packed.select(F.col("chunk").alias("pos"), F.col("max").alias("val"))
    chunk = next_ge(upper, targets).select("t", F.col("pos").alias("chunk"))
    return _open(chunk, packed, lambda ts, first, values: (ts, np.searchsorted(values, ts)))


def packed_get(packed: DataFrame, positions: DataFrame, size: int = elias_fano.CHUNK) -> DataFrame:
    """pos and val of the elements at positions (column t), each by opening its chunk; no row beyond the end."""

    def find(ts, first, values):
        ts = ts[ts < first + len(values)]
        return ts, ts - first

    return _open(positions.select("t", F.expr(f"t div {size}").alias("chunk")).where("t >= 0").distinct(), packed, find).select("pos", "val")

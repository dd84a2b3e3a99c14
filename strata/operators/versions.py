"""A versioned log: rows of key, version and position; the newest version of each key wins.

Layers are numbered from the newest (0). Versions order rows within a layer.

Edge cases, for all functions: a null key is a key like others in ``latest`` and ``merge``, overwrites nothing in
``discards`` (all its rows are there) and is met by nothing in ``multi_get`` and ``missing``; rows of equal key and version are one version, of which
``latest`` keeps any one; empty tables give empty ones; columns that are added for the time being take names that are
free, and a column named ``into`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flags import is_tombstone
from ..scratch import written

ENTRY_OVERHEAD = 64  # bytes that an entry counts besides its key


def latest(log: DataFrame, key: str = "key", order: tuple[str, ...] = ("ver",), layer: str | None = None) -> DataFrame:
    """The newest row of each key, tombstones included: the lowest layer, then the largest order. One partial and one final aggregate."""
    rank = [*([-F.col(layer)] if layer else []), *map(F.col, order)]
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(*rank)).alias("newest")).select("newest.*")


def live(newest: DataFrame, flag: str = "flag") -> DataFrame:
    return newest.where(~is_tombstone(F.col(flag)))


def merge(*layers: DataFrame, key: str = "key", order: tuple[str, ...] = ("ver",)) -> DataFrame:
    """Layers, newest first, as one: equal keys keep the row of the first layer that has them."""
    numbered = [x.withColumn("layer", F.lit(i)) for i, x in enumerate(layers)]
    out = numbered[0]
    for x in numbered[1:]:
        out = out.unionByName(x)
    return latest(out, key, order, "layer")


def discards(log: DataFrame, key: str = "key", order: tuple[str, ...] = ("ver",), layer: str = "layer") -> DataFrame:
    """Rows overwritten within their own layer: all but those of each (layer, key)'s newest version. A version is one row.
    The newest are found by a partial and a final aggregate and met by version too, so no key's rows meet in one task."""
    newest = log.groupBy(layer, key).agg(F.max(F.struct(*order)).alias("newest")).select(layer, key, "newest.*")
    return log.join(newest, [layer, key, *order], "left_anti").select(*log.columns)


def multi_get(newest: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return newest.join(keys.select(key).distinct(), key, "left_semi")


def missing(newest: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(newest, key, "left_anti")


def entry_bytes(key: Column) -> Column:
    return F.octet_length(key.cast("string")) + ENTRY_OVERHEAD


def compact(newest: DataFrame, deepest: bool, flag: str = "flag") -> DataFrame:
    """Tombstones may go only where nothing older lies below."""
    return live(newest, flag) if deepest else newest


def sorted_table(df: DataFrame, order: tuple[str, ...], also=None) -> tuple[DataFrame, Column, Column]:
    """df as a table whose files follow each other in order, with columns for a row's file and its place in it. One
    shuffle, by ranges of the order. also: what is done to each sorted part before it is written."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(also(parts) if also else parts), F.col("_metadata.file_name"), F.col("_metadata.row_index")


def _free(df: DataFrame, name: str) -> str:
    """The name, or one like it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: tuple[str, ...], into: str = "n") -> DataFrame:
    """Adds the position (from 0) in an order; positions of equal rows are dealt in any way. df is sorted by ranges and
    written once; only the number of rows of each file meets in one place. A column named ``into`` is replaced."""
    rows, file, place = sorted_table(df.drop(into), order)
    name, at = _free(rows, "file"), _free(rows, "at")
    held = rows.select("*", file.alias(name), place.alias(at))
    sizes = held.groupBy(name).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return held.join(F.broadcast(sizes.select(name, before.alias("before"))), name).withColumn(into, (F.col(at) + F.col("before")).cast("long")).select(*rows.columns, into)


def _folded(df: DataFrame, order: tuple[str, ...], value: Column, into: str, position: str | None, fold, over, both) -> DataFrame:
    """A running fold of whole numbers: by NumPy within each sorted part, then over the parts' last values."""
    added = [into, *([position] if position else [])]
    rows = df.drop(*added).withColumn(into, value.cast("long"))

    def run(batches):
        last = None
        for b in batches:
            x = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            if len(x):
                x = fold.accumulate(x if last is None else np.concatenate([[last], x]))
                x = x if last is None else x[1:]
                last = x[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.int64())], schema=b.schema)

    done, file, place = sorted_table(rows, order, lambda parts: parts.mapInArrow(run, parts.schema))
    name, at = _free(done, "file"), _free(done, "at")
    held = done.select("*", file.alias(name), place.alias(at))
    ends = held.groupBy(name).agg(F.max(into).alias("end"), F.count("*").alias("size"))
    earlier = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = ends.select(name, over("end").over(earlier).alias("before"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("above"))
    out = held.join(F.broadcast(before), name).withColumn(into, both(F.col(into), F.col("before")))
    return (out.withColumn(position, (F.col(at) + F.col("above")).cast("long")) if position else out).select(*df.drop(*added).columns, *added)


def running(df: DataFrame, order: tuple[str, ...], value: Column, into: str, position: str | None = None) -> DataFrame:
    """Adds the running sum of a whole number of 0 or more (null: 0) in an order, the row's own included; and the position, if named."""
    return _folded(df, order, F.coalesce(value, F.lit(0)), into, position, np.add, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)))


def running_max(df: DataFrame, order: tuple[str, ...], value: Column, into: str, position: str | None = None) -> DataFrame:
    """Adds the largest whole number so far (nulls aside) in an order, the row's own included; and the position, if named."""
    return _folded(df, order, F.coalesce(value, F.lit(-(2**63))), into, position, np.maximum, F.max, lambda own, before: F.greatest(own, before))


def rotated(log: DataFrame, writer: str, order: tuple[str, ...], size: Column, limit: int) -> DataFrame:
    """writer, segment, n, bytes and the first and last order (of its first column) of each segment. A writer's entries
    go to one segment after another; one that has reached the limit is closed before the next entry, so it may overshoot
    by one entry. A group is one writer's log; each step jumps a whole segment."""

    def run(table: pa.Table) -> pa.Table:
        by = np.lexsort([table.column(f"o{i}").to_numpy() for i in reversed(range(len(order)))])
        ends, place = np.cumsum(table.column("size").to_numpy()[by]), table.column("o0").to_numpy()[by]
        out, start, done = [], 0, 0
        while start < len(ends):
            stop = min(int(np.searchsorted(ends, done + limit)) + 1, len(ends))
            out.append((len(out), stop - start, int(ends[stop - 1]) - done, int(place[start]), int(place[stop - 1])))
            start, done = stop, int(ends[stop - 1])
        told = {name: pa.array(c, pa.int64()) for name, c in zip(("segment", "n", "bytes", "first", "last"), zip(*out))}
        return pa.table({"writer": pa.array([table.column("writer")[0].as_py()] * len(out), pa.int64()), **told})

    rows = log.select(F.col(writer).cast("long").alias("writer"), *[F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate(order)], size.cast("long").alias("size"))
    return rows.groupBy("writer").applyInArrow(run, "writer long, segment long, n long, bytes long, first long, last long").withColumnRenamed("writer", writer)

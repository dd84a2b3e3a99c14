"""A stream of log rows kept as segments, one generation for each micro-batch; batches may be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import segments


def run(source: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame], key: str = "key", parts: int = 1) -> None:
    """Reads all that is there. A micro-batch is a generation named by its number: data first, then one commit, so readers
    never see half a batch, and a batch that is retried is there once."""

    def put(batch: DataFrame, number: int) -> None:
        rows = shape(batch)
        if not rows.isEmpty():
            segments.write(rows, path, key, parts, generation=f"batch{number}")

    source.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All rows of the committed batches."""
    return segments.read(spark, path, "key", upto=upto)

"""Tables that operators write on their way, in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine if Spark runs in this process
    alone, as in tests; an error on a cluster, whose executors could not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strata-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder's path under the shared one."""
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in such a folder: computed once, however often it is read, and safe from lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

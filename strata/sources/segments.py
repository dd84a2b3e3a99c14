"""Sorted Parquet segments with a versioned manifest, written and read with pruning.

A store is a folder: ``data/<generation>`` has segments, ``ops/<generation>`` what a commit adds and removes
(a row for each segment with its key range), and ``log/<version>-<generation>`` is an empty file for each commit. A
commit writes data, then its operations, then the one file in ``log``, whose creation publishes all of it at once:
a reader sees all of a commit or nothing, and whoever holds a version reads what it had. Live segments of a version
are those whose last operation adds them; ``live/<version>`` keeps those of a version, so that not all operations are
replayed. A store has one writer at a time, any number of readers.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounds import Range, overlaps
from ..functions.flags import is_tombstone
from ..operators import levels, versions
from ..operators.levels import CODECS

OPS = "file string, generation string, level int, min {kind}, max {kind}, n long, size long, rmed long, end_offset long, add boolean"
GRACE_SECONDS = 3_600  # that data without a commit may be about to get one
MIB = 1024 * 1024


@dataclass(frozen=True)
class Settings:
    """How segments of a level are stored. ``of`` takes the level's own and then overrides, of which the last wins."""

    codec: str = "none"
    strength: int = 0
    row_group: int = 8 * MIB
    dictionary: bool = True
    bloom: bool = True
    more: dict = field(default_factory=dict)

    @classmethod
    def of(cls, level: int, *overrides: dict) -> Settings:
        codec, strength = CODECS[level]
        known: dict = {"codec": codec, "strength": strength}
        for x in overrides:
            known |= x
        own = {k: known.pop(k) for k in list(known) if k in cls.__dataclass_fields__}
        return cls(**own | {"more": known})

    def options(self, key: str) -> dict[str, str]:
        codec = "lz4_raw" if self.codec == "lz4" else self.codec  # the form of it that all readers know
        out = {
            "compression": codec,
            "parquet.block.size": str(self.row_group),
            "parquet.enable.dictionary": str(self.dictionary).lower(),
            f"parquet.bloom.filter.enabled#{key}": str(self.bloom).lower(),
        }
        if self.codec == "zstd":
            out["parquet.compression.codec.zstd.level"] = str(self.strength)
        return out | {k: str(v) for k, v in self.more.items()}


class _Files:
    """The store's folder through Hadoop's file system, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.fs = path, self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def list(self, folder: str) -> list:
        at = self.make(f"{self.path}/{folder}")
        return list(self.fs.listStatus(at)) if self.fs.exists(at) else []

    def create(self, name: str) -> None:
        if not self.fs.createNewFile(self.make(f"{self.path}/{name}")):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.make(f"{self.path}/{name}"), True)


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, generation) of all commits, in order."""
    names = [s.getPath().getName() for s in _Files(spark, path).list("log")]
    return sorted((int(v), g) for v, _, g in (x.partition("-") for x in names if not x.startswith(("_", "."))))


def version(spark: SparkSession, path: str) -> int:
    """The latest version; 0 if nothing is committed."""
    return max((v for v, _ in _commits(spark, path)), default=0)


def commit(spark: SparkSession, path: str, generation: str, ops: DataFrame) -> int:
    """Publishes operations (rows of OPS) as the next version; its number. A generation that is there already is left as it is."""
    known = _commits(spark, path)
    for v, g in known:
        if g == generation:
            return v
    ops.coalesce(1).write.mode("overwrite").parquet(f"{path}/ops/{generation}")
    at = max((v for v, _ in known), default=0) + 1
    _Files(spark, path).create(f"log/{at:012d}-{generation}")
    return at


def stage(df: DataFrame, path: str, key: str, parts: int, level: int = 0, generation: str | None = None, flag: str | None = None, settings: Settings | None = None) -> tuple[str, DataFrame]:
    """Writes a generation of segments, sorted and apart by key, and returns it with the operations that add them. Not
    committed yet. flag: a column whose tombstones count as removed bytes."""
    spark, name = df.sparkSession, generation or uuid.uuid4().hex
    sorted_rows = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    sorted_rows.write.mode("overwrite").options(**(settings or Settings.of(level)).options(key)).parquet(f"{path}/data/{name}")
    dead = F.count(F.when(is_tombstone(F.col(flag)), 1)) if flag else F.lit(0)
    rows = spark.read.schema(df.schema).parquet(f"{path}/data/{name}").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    zones = rows.groupBy("file").agg(F.min(key).alias("min"), F.max(key).alias("max"), F.count("*").alias("n"), F.max("bytes").alias("size"), dead.cast("long").alias("dead"))
    adds = zones.select(
        "file", F.lit(name).alias("generation"), F.lit(level).alias("level"), "min", "max", "n", "size",
        F.floor(F.col("size") * F.col("dead") / F.col("n")).cast("long").alias("rmed"), F.col("size").alias("end_offset"), F.lit(True).alias("add"),
    )
    return name, adds


def write(df: DataFrame, path: str, key: str, parts: int, level: int = 0, generation: str | None = None, flag: str | None = None, settings: Settings | None = None) -> int:
    """A generation of segments, committed; the version. Repeated with the same generation it is there once."""
    spark = df.sparkSession
    if generation:
        for v, g in _commits(spark, path):
            if g == generation:
                return v
    return commit(spark, path, *stage(df, path, key, parts, level, generation, flag, settings))


def operations(spark: SparkSession, path: str, upto: int | None = None, after: int = 0) -> DataFrame | None:
    """All operations of the versions after one with the version that did them; None if there are none."""
    known = [(v, g) for v, g in _commits(spark, path) if v > after and (upto is None or v <= upto)]
    if not known:
        return None
    rows = spark.read.parquet(*[f"{path}/ops/{g}" for _, g in known])
    numbers = spark.createDataFrame(known, "version long, by string")
    by = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("by", by).join(F.broadcast(numbers), "by").drop("by")  # a row for each commit


def _checkpoints(spark: SparkSession, path: str, upto: int | None) -> list[int]:
    names = [x.getPath().getName() for x in _Files(spark, path).list("live")]
    return [int(x) for x in names if x.isdigit() and (upto is None or int(x) <= upto)]


def checkpoint(spark: SparkSession, path: str) -> int:
    """Keeps the live segments of the latest version as they are, so that readers replay only what came later; the version."""
    at, live = version(spark, path), manifest(spark, path)
    if live is not None and at not in _checkpoints(spark, path, None):
        live.coalesce(1).write.mode("overwrite").parquet(f"{path}/live/{at}-rows")
        _Files(spark, path).create(f"live/{at}")
    return at


def manifest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """Live segments of a version, the latest by default, with the version that added them: those of the last checkpoint
    before it and all operations since, of which the last one of a segment wins."""
    base = max(_checkpoints(spark, path, upto), default=0)
    ops = operations(spark, path, upto, base)
    if base:
        held = spark.read.parquet(f"{path}/live/{base}-rows")
        ops = held.withColumn("add", F.lit(True)).unionByName(ops) if ops is not None else held.withColumn("add", F.lit(True))
    return None if ops is None else levels.replay(ops, "file", "version").drop("add")


def read(spark: SparkSession, path: str, key: str, lo=None, hi=None, lo_inc: bool = True, hi_inc: bool = False, upto: int | None = None, own: bool = False) -> DataFrame:
    """Rows in a key range, from the files whose zone overlaps it only, of a version (the latest by default). Keys may be
    numbers, strings or bytes. own: with ``_version`` and ``_level`` of their segment."""
    asked = Range(F.lit(lo), F.lit(lo_inc), F.lit(hi), F.lit(hi_inc))
    zones = manifest(spark, path, upto)
    if zones is None:
        raise FileNotFoundError(path)
    zones = zones.where(overlaps(asked, Range(F.col("min"), F.lit(True), F.col("max"), F.lit(True)))).select("file", "generation", "version", "level")
    picked = list(zones.toLocalIterator())
    some = [r["file"] for r in picked] or [manifest(spark, path, upto).first()["file"]]
    df = spark.read.schema(spark.read.parquet(some[0]).schema).parquet(*some)
    if not picked:
        df = df.limit(0)
    if own:
        at = spark.createDataFrame([(r["generation"], r["version"], r["level"]) for r in {r["generation"]: r for r in picked}.values()], "_generation string, _version long, _level int")
        df = df.withColumn("_generation", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(F.broadcast(at), "_generation").drop("_generation")
    for end, keep in ((lo, F.col(key) >= lo if lo_inc else F.col(key) > lo), (hi, F.col(key) <= hi if hi_inc else F.col(key) < hi)):
        df = df if end is None else df.where(keep)
    return df


def latest(spark: SparkSession, path: str, key: str, order: tuple[str, ...], lo=None, hi=None, lo_inc: bool = True, hi_inc: bool = False, upto: int | None = None) -> DataFrame:
    """The newest row of each key over all segments, tombstones included: the largest order, of equal ones the one of the latest commit."""
    rows = read(spark, path, key, lo, hi, lo_inc, hi_inc, upto, own=True)
    return versions.latest(rows, key, (*order, "_version")).drop("_version", "_level")


def removals(live: DataFrame) -> DataFrame:
    """The operations that remove live segments."""
    return live.drop("version").withColumn("add", F.lit(False))


def compact_once(spark: SparkSession, path: str, key: str, order: tuple[str, ...], flag: str, parts: int) -> tuple[int, int] | None:
    """One step of compaction: the level that is due, as ``levels.compaction_pick`` has it, goes with what it overlaps in
    its target level into new segments there, in one commit. The levels, or None if nothing is due."""
    live = manifest(spark, path)
    scored = live.select(F.col("file").alias("id"), "level", "size", "rmed") if live is not None else None
    pick = levels.compaction_pick(scored).first() if scored is not None else None
    if pick is None:
        return None
    upper = live.where(F.col("level") == pick["from_level"])
    if pick["id"] is not None:
        upper = upper.where(F.col("file") == pick["id"])
    ends = upper.agg(F.min("min").alias("lo"), F.max("max").alias("hi")).first()
    asked = Range(F.lit(ends["lo"]), F.lit(True), F.lit(ends["hi"]), F.lit(True))
    lower = live.where((F.col("level") == pick["to_level"]) & overlaps(asked, Range(F.col("min"), F.lit(True), F.col("max"), F.lit(True))))
    going = upper.unionByName(lower)
    files = [r["file"] for r in going.select("file").toLocalIterator()]
    deepest = live.where(F.col("level") > pick["to_level"]).isEmpty()
    numbers = spark.createDataFrame([tuple(r) for r in going.select("generation", "version").distinct().collect()], "_generation string, _version long")
    rows = spark.read.schema(spark.read.parquet(files[0]).schema).parquet(*files).withColumn("_generation", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    newest = versions.latest(rows.join(F.broadcast(numbers), "_generation"), key, (*order, "_version")).drop("_generation", "_version")
    name, adds = stage(versions.compact(newest, deepest, flag), path, key, parts, pick["to_level"], flag=flag)
    commit(spark, path, name, removals(going).unionByName(adds))
    return pick["from_level"], pick["to_level"]


def replace(df: DataFrame, path: str, key: str, parts: int = 1, level: int = 0) -> int:
    """df in place of all that is live, in one commit; the version. Readers find the old rows or the new ones."""
    spark, old = df.sparkSession, manifest(df.sparkSession, path)
    name, adds = stage(df, path, key, parts, level)
    return commit(spark, path, name, adds if old is None else removals(old).unionByName(adds))


def vacuum(spark: SparkSession, path: str, keep_from: int | None = None, grace: float = GRACE_SECONDS) -> int:
    """Deletes generations that no version from keep_from on (the latest by default) reads; how many went. Data without
    a commit may be one that is being written, and stays until it is older than grace seconds."""
    files, known = _Files(spark, path), _commits(spark, path)
    last = max((v for v, _ in known), default=0)
    least = last if keep_from is None else keep_from
    named: set[str] = set()
    if known:
        ops = operations(spark, path)
        gone = ops.where(~F.col("add")).groupBy("file").agg(F.max("version").alias("gone"))
        held = ops.where("add").join(gone, "file", "left").where(F.col("gone").isNull() | (F.col("gone") > least))
        named = {r["generation"] for r in held.select("generation").distinct().toLocalIterator()}
    committed, out = {g for _, g in known}, 0
    for s in files.list("data"):
        name = s.getPath().getName()
        young = name not in committed and time.time() - s.getModificationTime() / 1000 < grace
        if name not in named and not young:
            files.delete(f"data/{name}")
            out += 1
    return out

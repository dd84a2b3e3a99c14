"""Level statistics, compaction scores and picks, and replay of the manifest log.

Fixed values of the scoring rules: scores are in 1/128; level 0 scores by its number of files against 4,
and above 8 it is full; a level is an eighth of the next; the smallest target is 256 MiB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL = 4_294_967_295
SCALE, L0_FILES, L0_FULL, FANOUT, LEAST_TARGET, LAST = 128, 4, 8, 8, 256 * 1024 * 1024, 6
CODECS = {0: ("none", 0), 1: ("lz4", 1), 2: ("lz4", 1), 3: ("zstd", 1), 4: ("zstd", 3), 5: ("zstd", 7), 6: ("zstd", 9)}


def virtual_size() -> Column:
    return F.col("size") + F.col("rmed")


def level_sizes(segments: DataFrame) -> DataFrame:
    return segments.groupBy("level").agg(F.count("*").cast("long").alias("files"), F.sum(virtual_size()).cast("long").alias("actual"))


def level_targets(total: DataFrame) -> DataFrame:
    """level 1 to 6 and target for one row of total: the last level gets all, each one above an eighth, none under 256 MiB but the last."""
    level = F.explode(F.sequence(F.lit(1), F.lit(LAST))).alias("level")
    share = F.expr(f"total div cast(pow({FANOUT}, {LAST} - level) as bigint)")
    return total.select("total", level).select("level", F.when((F.col("level") == LAST) | (share >= LEAST_TARGET), share).otherwise(F.lit(0)).cast("long").alias("target"))


def level_table(segments: DataFrame) -> DataFrame:
    """level 0 to 6 with files, actual, target and the base level that data leaves level 0 for. Seven rows."""
    sizes = level_sizes(segments)
    total = sizes.agg(F.coalesce(F.sum("actual"), F.lit(0)).cast("long").alias("total"))
    targets = level_targets(total).union(total.select(F.lit(0), F.lit(0).cast("long")))
    levels = targets.join(sizes, "level", "left").select(
        "level", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("actual", F.lit(0)).cast("long").alias("actual"), "target"
    )
    all_levels = Window.partitionBy(F.lit(0))  # seven rows
    base = F.coalesce(F.min(F.when((F.col("target") > 0) & (F.col("level") > 0), F.col("level"))).over(all_levels), F.lit(LAST))
    levels = levels.withColumn("target_base", base)
    used = F.min(F.when((F.col("actual") > 0) & (F.col("level") > 0) & (F.col("level") < F.col("target_base")), F.col("level"))).over(all_levels)
    return levels.withColumn("base", F.coalesce(used, "target_base"))


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient of two whole numbers, 0 if the second is 0."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, F.when(b == 0, F.lit(1)).otherwise(b)))


def level_score(level: Column, files: Column, actual: Column, target: Column) -> Column:
    first = F.when(files > L0_FULL, F.lit(FULL)).otherwise(_div(files * SCALE, L0_FILES))
    ratio = F.least(_div(actual * SCALE, target), F.lit(FULL - 1))
    rest = F.when(target == 0, F.when(actual > 0, F.lit(FULL)).otherwise(F.lit(0))).otherwise(ratio)
    return F.when(level == 0, first).otherwise(rest).cast("long")


def level_scores(segments: DataFrame) -> DataFrame:
    """Levels 0 to 5 with their score; the last level has none."""
    t = level_table(segments).where(F.col("level") < LAST)
    return t.withColumn("score", level_score(F.col("level"), F.col("files"), F.col("actual"), F.col("target")))


def file_scores(segments: DataFrame) -> DataFrame:
    score = F.when(F.col("size") == 0, F.lit(FULL)).otherwise(_div(F.col("rmed") * SCALE, F.col("size")))
    return segments.withColumn("score", score.cast("long"))


def compaction_pick(segments: DataFrame) -> DataFrame:
    """from_level, to_level and id (null for level 0, which goes whole) of the next compaction, or no row: the largest
    score of 128 at least, the deepest level if equal; of its files the largest file score, the latest if equal."""
    top = level_scores(segments).orderBy(F.desc("score"), F.desc("level")).limit(1).where(F.col("score") >= SCALE)
    head = file_scores(segments).groupBy("level").agg(F.max_by("id", F.struct("score", "id")).alias("id"))
    to = F.when(F.col("level") == 0, F.col("base")).when(F.col("level") < F.col("base"), F.col("base")).otherwise(F.col("level") + 1)
    return (
        top.join(head, "level", "left").where("level = 0 or id is not null")
        .select(F.col("level").alias("from_level"), to.cast("int").alias("to_level"), F.when(F.col("level") > 0, F.col("id")).alias("id"))
    )


def replay(ops: DataFrame, key: str = "id", seq: str = "seq", add: str = "add") -> DataFrame:
    """The rows of ids whose last operation, in order of sequence, adds them; an operation removes before it adds."""
    last = ops.groupBy(key).agg(F.max_by(F.struct(*ops.columns), F.struct(seq, add)).alias("last")).select("last.*")
    return last.where(F.col(add))

"""Connected components of an edge table, and joins by keys of which a few are in very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

HEAVY = 200  # a key is heavy if more than 1 row in HEAVY has it: fewer than HEAVY keys are
LEAST = 1_000  # rows, at least
SALTS = 64


def heavy_keys(df: DataFrame, key: str, rows: str | None = None) -> list:
    """The heavy keys of df, fewer than HEAVY; rows: a column that says how many rows each row stands for. Counts are summed before their shuffle."""
    n = F.sum(rows) if rows else F.count("*")
    total = df.agg(n).first()[0] or 0
    if total <= LEAST:
        return []
    return [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n")).where(F.col("n") > max(LEAST, total // HEAVY)).select(key).collect()]


def _is_heavy(key: str, heavy: list) -> Column:
    return F.col(key).isin(heavy) if heavy else F.lit(False)


def spread(df: DataFrame, key: str, heavy: list, by: str) -> DataFrame:
    """df with ``salt``: rows of a heavy key get one of SALTS, by another column; others 0."""
    return df.withColumn("salt", F.when(_is_heavy(key, heavy), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))


def copies(df: DataFrame, key: str, heavy: list) -> DataFrame:
    """df with ``salt``, to be joined with ``spread`` by key and salt: a row for each salt of a heavy key."""
    if not heavy:
        return df.withColumn("salt", F.lit(0))
    return df.withColumn("salt", F.explode(F.when(_is_heavy(key, heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def lookup(df: DataFrame, key: str, table: DataFrame, by: str) -> DataFrame:
    """df left joined with a table that has each key at most once; rows of heavy keys are spread by another column."""
    heavy = heavy_keys(df, key)
    return spread(df, key, heavy, by).join(copies(table, key, heavy), [key, "salt"], "left").drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node that it is linked with, over any number of edges) of every end of an edge.

    By contraction: in each round a node points to the one of its neighbours and itself that comes first in the order of
    their hashes, pointers are followed once more, and each edge becomes one between what its ends point to; loops and
    repeats go, so a round leaves a fraction of the nodes, of a chain as of a star, and edges are met once or twice in
    all. Heavy keys (a node with very many neighbours, what most nodes point to) are spread over SALTS parts and minima
    are taken before their shuffle, so no hub meets in one task. Each round is written to the shared folder. Null ends
    and loops link nothing; repeated edges are one; an empty table gives an empty one.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    links, of = written(_apart(ends), "edges"), None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        one = written(both.groupBy("node").agg(F.min(first("to")).alias("least")).select("node", F.least(first("node"), F.col("least"))["to"].alias("via")), "pointers")
        far = lookup(one, "via", one.select(F.col("node").alias("via"), F.col("via").alias("far")), "node")
        two = written(far.select("node", F.coalesce("far", "via").alias("via")), "pointers")
        left = lookup(links, "a", two.select(F.col("node").alias("a"), F.col("via").alias("x")), "b")
        half = written(left.select("x", "b"), "halves")
        right = lookup(half, "b", two.select(F.col("node").alias("b"), F.col("via").alias("y")), "x")
        rest = written(_apart(right.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")), "edges")
        new = two
        if of is not None:
            now = lookup(of, "via", two.select(F.col("node").alias("via"), F.col("via").alias("far")), "node")
            new = written(now.select("node", F.coalesce("far", "via").alias("via")), "pointers")
            discard(of, two)
        discard(one, half, links)
        links, of = rest, new
    if of is None:
        none = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        none.written_at = links.written_at
        return none
    found = lookup(of, "via", of.groupBy("via").agg(F.min("node").alias("component")), "node")
    out = written(found.select("node", "component"), "components")
    discard(of)
    return out


def _apart(pairs: DataFrame) -> DataFrame:
    """Each pair once, its smaller end first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

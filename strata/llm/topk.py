"""Exact top-k search in binary codes by incremental multi-index hashing.

Codes are the signs of a vector's numbers. Codes are dealt to blocks; each block indexes every code once
for each segment. A query looks up, in every segment, the values at distance 0, 1, 2 ... from its own.
With all values within radius r looked up in m segments, every code within m * (r + 1) - 1 has been
found, so a query is done with a block when its k-th distance is at most that; then the best k of all
blocks are the result. Blocks hold at most BLOCK rows, so memory is bounded; many rows of one code are
spread over all blocks, as rows are dealt by id.

Neighbours are ordered by distance, then id; a query row is a neighbour of itself.

Edge cases: rows with a null or empty vector, null ids or null numbers have no code and neither search
nor are found; queries whose table holds fewer than k codes get all; vectors of different lengths only
find their like; repeated rows are found as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written

K = 10
SEGMENT = 16  # bits; about log2 of BLOCK
BLOCK = 65_536


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, dims and code (a bit for each number, 1 if it is 0 or more) of each row that has one."""

    def run(batches):
        for b in batches:
            ids, dims, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None and v and None not in v:
                    ids.append(i)
                    dims.append(len(v))
                    out.append(np.packbits(np.array(v) >= 0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dims", "code"])

    return vectors.select(F.col(key).cast("long"), F.col(vector)).transform(in_batches, run, "id long, dims int, code binary")


class Block:
    """Codes of one length with an index by each segment."""

    def __init__(self, ids: np.ndarray, packed: np.ndarray, dims: int) -> None:
        order = np.lexsort((ids, *packed.T[::-1]))
        ids, packed = ids[order], packed[order]
        new = np.concatenate([[True], (packed[1:] != packed[:-1]).any(axis=1)])
        self.ids, self.first = ids, np.append(np.flatnonzero(new), len(ids))
        self.codes = packed[new]
        bits = np.unpackbits(self.codes, axis=1, count=dims)
        self.cuts = [(s, min(s + SEGMENT, dims)) for s in range(0, dims, SEGMENT)]
        self.index = []
        for s, e in self.cuts:
            value = bits[:, s:e].astype(np.int64) @ (1 << np.arange(e - s)[::-1])
            at = np.argsort(value, kind="stable")
            self.index.append((at, np.searchsorted(value[at], np.arange((1 << (e - s)) + 1))))
        self.flips: dict[tuple[int, int], np.ndarray] = {}

    def _flips(self, width: int, r: int) -> np.ndarray:
        if (width, r) not in self.flips:
            self.flips[width, r] = np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)
        return self.flips[width, r]

    def search(self, code: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(distance, id) of the k nearest, ordered."""
        bits = np.unpackbits(code)
        seen = np.zeros(len(self.codes), bool)
        at, distance, m = np.zeros(0, np.int64), np.zeros(0, np.int64), len(self.cuts)
        rows = np.diff(self.first)
        for r in range(SEGMENT + 1):
            for (s, e), (order, starts) in zip(self.cuts, self.index):
                if r > e - s:
                    continue
                values = int("".join(map(str, bits[s:e])), 2) ^ self._flips(e - s, r)
                lo, n = starts[values], starts[values + 1] - starts[values]
                lo, n = lo[n > 0], n[n > 0]
                found = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                found = found[~seen[found]]
                seen[found] = True
                at = np.concatenate([at, found])
                distance = np.concatenate([distance, np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64)])
            if rows[at[distance <= m * (r + 1) - 1]].sum() >= k:  # the k-th is provably among these
                break
        out: list[tuple[int, int]] = []
        for d in np.unique(distance):
            same = at[distance == d]
            out += sorted((int(d), int(i)) for c in same for i in self.ids[self.first[c] : min(self.first[c] + k, self.first[c + 1])])[:k]
            if len(out) >= k:
                break
        return out[:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance: the k nearest of vectors for each row of queries."""
    index = written(codes(vectors, key, vector), "codes")
    n = max(1, -(-index.count() // block))
    asked = codes(queries, key, vector).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = index.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    schema = "query_id long, id long, distance int"

    def run(_, left, right):
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            table = Block(left.column("id").to_numpy(), _matrix(left.column("code"), dims), dims)
            for q, c in zip(right.column("id").to_pylist(), _matrix(right.column("code"), dims)):
                out += [(q, i, d) for d, i in table.search(c, k)]
        return pa.table([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["query_id", "id", "distance"])

    best = dealt.groupBy("b", "dims").cogroup(asked.distinct().groupBy("b", "dims")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    kept = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbour_id"), F.col("distance").cast("long").alias("distance"))


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, (dims + 7) // 8)


ORACLE_SQL = """
WITH bits AS (SELECT vec_id, len(embedding) AS dims, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS code FROM embeddings WHERE len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, list_sum(list_transform(list_zip(q.code, v.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM bits q JOIN bits v ON q.dims = v.dims WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::BIGINT AS rank, neighbour_id, distance
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) <= 10
"""

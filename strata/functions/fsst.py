"""String compression by a table of up to 255 symbols of 1 to 8 bytes.

Every value is coded on its own: a byte below 255 stands for a symbol, 255 goes before a literal byte. At each
place the symbol of 3 bytes or more is tried that hashes to the place's first three bytes, then one of two bytes,
then one of one; so a table holds at most one long symbol for each hash.

The table is trained on a bounded sample in rounds: the sample is coded by the current table, symbols and pairs of
neighbouring symbols are counted, and those with the largest gain (bytes times count) make the next table. Symbols
of several bytes never hold the sample's least frequent byte, the terminator. The finished table is numbered by
length: two bytes first (of these, those that begin a longer symbol before the rest), then 3 to 8, then 1.

A batch of values is coded at once in NumPy: what fits at every byte is looked up for all bytes together, one short
loop follows the matches from each value's start, and codes and literals are then gathered together again.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format
ESCAPE = 255
LONGEST = 8
HASH_PRIME = 2971215073
HASH_SHIFT = 15
HASH_SLOTS = 1024
SAMPLE_BYTES = 16_384
ROUNDS = (8, 38, 68, 98, 108, 128)  # of 128
LEAST_COUNT = 5  # of a candidate, in the last round; less by the round's part
SINGLE_BOOST = 8  # what a single byte's count is multiplied by
MOST_COUNT = 65_535

BATCH_BYTES = "4m"
RUN_BYTES = 16_384


def hash_of(word: int) -> int:
    """The hash of three bytes, little-endian, in unsigned 64-bit arithmetic."""
    h = word * HASH_PRIME & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> HASH_SHIFT)


def _slot(symbol: bytes) -> int:
    return hash_of(int.from_bytes(symbol[:3], "little")) % HASH_SLOTS


def fitting(symbols: list[bytes]) -> list[bytes]:
    """The symbols that a table takes: of long ones that share a slot the first, 255 at most."""
    taken: set[int] = set()
    out = []
    for s in symbols:
        if len(s) > 2:
            if _slot(s) in taken:
                continue
            taken.add(_slot(s))
        out.append(s)
        if len(out) == ESCAPE:
            break
    return out


def by_length(symbols: list[bytes]) -> list[bytes]:
    """The symbols in order of their final codes."""
    heads = {s[:2] for s in symbols if len(s) > 2}
    rank = lambda s: (0 if s in heads else 1) if len(s) == 2 else 10 if len(s) == 1 else len(s)
    return sorted(symbols, key=rank)


class Table:
    """Symbols in order of their codes, and the three lookups."""

    def __init__(self, symbols: list[bytes]) -> None:
        if len(symbols) > ESCAPE:
            raise ValueError("more than 255 symbols")
        self.symbols = symbols
        self.long_value, self.long_size, self.long_code = np.zeros(HASH_SLOTS, np.uint64), np.zeros(HASH_SLOTS, np.int64), np.zeros(HASH_SLOTS, np.int16)
        self.two, self.one = np.full(1 << 16, -1, np.int16), np.full(1 << 8, -1, np.int16)
        self.bytes_of, self.size_of = np.zeros((256, LONGEST), np.uint8), np.zeros(256, np.int64)
        for code, s in enumerate(symbols):
            self.size_of[code] = len(s)
            self.bytes_of[code, : len(s)] = np.frombuffer(s, np.uint8)
            if len(s) == 1:
                self.one[s[0]] = code
            elif len(s) == 2:
                self.two[int.from_bytes(s, "little")] = code
            else:
                at = _slot(s)
                if self.long_size[at]:
                    raise ValueError("two symbols in one slot")
                self.long_value[at], self.long_size[at], self.long_code[at] = int.from_bytes(s, "little"), len(s), code
        self.mask = np.array([(1 << 8 * n) - 1 for n in range(LONGEST + 1)], np.uint64)[self.long_size]

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each byte (-1: a literal) and how many bytes it stands for; ends: where each byte's value ends."""
        n = len(data)
        wide = np.zeros(n + LONGEST, np.uint64)
        wide[:n] = data
        word = wide[:n].copy()
        for k in range(1, LONGEST):
            word |= wide[k : n + k] << np.uint64(8 * k)
        room = ends - np.arange(n)
        h = (word & np.uint64(0xFFFFFF)) * np.uint64(HASH_PRIME)
        at = ((h ^ (h >> np.uint64(HASH_SHIFT))) & np.uint64(HASH_SLOTS - 1)).astype(np.int64)
        code = self.one[data]
        size = np.ones(n, np.uint8)
        two = self.two[(word & np.uint64(0xFFFF)).astype(np.int64)]
        on = (two >= 0) & (room >= 2)
        code[on], size[on] = two[on], 2
        on = (self.long_size[at] > 0) & (self.long_size[at] <= room) & ((word & self.mask[at]) == self.long_value[at])
        code[on], size[on] = self.long_code[at[on]], self.long_size[at[on]]
        return code, size

    def encode_all(self, values: list[bytes]) -> list[bytes]:
        """Each value coded."""
        return [x for run in _runs(values) for x in self._encode(run)]

    def decode_all(self, values: list[bytes]) -> list[bytes]:
        """Each value as it was."""
        return [x for run in _runs(values) for x in self._decode(run)]

    def _encode(self, values: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(values), np.uint8)
        if not len(data):
            return [b""] * len(values)
        sizes = np.array([len(v) for v in values], np.int64)
        code, size = self.matches(data, np.repeat(np.cumsum(sizes), sizes))
        steps, path, i, n = size.tobytes(), [], 0, len(data)
        add = path.append
        while i < n:  # no match runs past the end of its value, so one walk meets the start of each
            add(i)
            i += steps[i]
        path = np.array(path, np.int64)
        code = code[path]
        literal = code < 0
        place = np.cumsum(1 + literal) - 1  # of each code, or literal
        out = np.full(int(place[-1]) + 1, ESCAPE, np.uint8)
        out[place] = np.where(literal, data[path], code)
        first = np.searchsorted(path, np.cumsum(sizes) - sizes)  # the value's first code
        start = np.append(place - literal, len(out))[first]
        return _cut(out.tobytes(), start)

    def _decode(self, values: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(values), np.uint8)
        if not len(data):
            return [b""] * len(values)
        n = len(data)
        mark = data == ESCAPE
        before = np.concatenate([[False], mark[:-1]])
        run = np.maximum.accumulate(np.where(mark & ~before, np.arange(n), 0))
        escape = mark & ((np.arange(n) - run) % 2 == 0)  # in a run of 255s each second one is a literal
        literal = np.concatenate([[False], escape[:-1]])
        size = np.where(escape, 0, np.where(literal, 1, self.size_of[data]))
        wide = self.bytes_of[data]
        wide[literal, 0] = data[literal]
        out = wide[np.arange(LONGEST) < size[:, None]].tobytes()
        sizes = np.array([len(v) for v in values], np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        return _cut(out, total[np.cumsum(sizes) - sizes])

    def encode(self, value: bytes) -> bytes:
        return self.encode_all([value])[0]

    def decode(self, value: bytes) -> bytes:
        return self.decode_all([value])[0]


def _runs(values: list[bytes]):
    """The values in runs of about RUN_BYTES, or of one longer value: what is worked on at once fits the cache."""
    run, held = [], 0
    for v in values:
        if run and held + len(v) > RUN_BYTES:
            yield run
            run, held = [], 0
        run.append(v)
        held += len(v)
    if run:
        yield run


def _cut(data: bytes, starts: np.ndarray) -> list[bytes]:
    at = [*starts.tolist(), len(data)]
    return [data[a:b] for a, b in zip(at, at[1:])]


def _parts(table: Table, value: bytes) -> list[bytes]:
    """The value in the pieces that the table codes."""
    size = table.matches(np.frombuffer(value, np.uint8), np.full(len(value), len(value)))[1].tobytes()
    out, i = [], 0
    while i < len(value):
        out.append(value[i : i + size[i]])
        i += size[i]
    return out


def train(values: list[bytes]) -> Table:
    """A table for the values; an error if there is nothing to learn from. Every round reads all of them; its part of 128
    says how often a candidate has to be seen, and the last one forms no pairs."""
    values = [v for v in values if v]
    if not values:
        raise ValueError("nothing to train on")
    seen = Counter(b"".join(values))
    terminator = min(range(256), key=lambda b: (seen[b], b))
    table, best, most = Table([]), None, -1
    known: set[bytes] = set()
    for part in ROUNDS:
        single: Counter[bytes] = Counter()
        pair: Counter[tuple[bytes, bytes]] = Counter()
        gain = 0
        for v in values:
            parts = _parts(table, v)
            gain += sum(max(0, len(p) - (1 if p in known else 2)) for p in parts)
            single.update(parts)
            single.update(v[i : i + 1] for i in _inner_starts(parts))
            if part < 128:
                pair.update(zip(parts, parts[1:]))
                pair.update((a, b[:1]) for a, b in zip(parts, parts[1:]) if len(b) > 1)
        if gain >= most:
            best, most = table, gain
        least, worth = LEAST_COUNT * part // 128, Counter()
        for s, n in single.items():
            n = min(n, MOST_COUNT) * (SINGLE_BOOST if len(s) == 1 else 1)
            if n >= least:
                worth[s] += n * len(s)
        for (a, b), n in pair.items():
            if len(a) < LONGEST and a[0] != terminator and b[0] != terminator and n >= least:
                worth[(a + b)[:LONGEST]] += min(n, MOST_COUNT) * len((a + b)[:LONGEST])
        table = Table(fitting([s for s, _ in sorted(worth.items(), key=lambda x: (-x[1], x[0]))]))
        known = set(table.symbols)
    if not best.symbols:
        raise ValueError("no symbol is worth its code")
    return Table(by_length(best.symbols))


def _inner_starts(parts: list[bytes]) -> list[int]:
    """Where each part after one of several bytes begins."""
    ends = list(accumulate(map(len, parts)))
    return [e for p, e in zip(parts, ends[:-1]) if len(p) > 1]


def train_on(df: DataFrame, column: str, key: str) -> Table:
    """A table from the whole values of least key hash, SAMPLE_BYTES or a little more of them; the same at every run."""
    v = F.col(column).cast("binary")
    rows = df.select(v.alias("v"), F.length(v).alias("n"), F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.xxhash64(v).alias("w")).where("n > 0")
    order, most, sizes = ("h", "k", "w"), 256, []
    while True:  # of each task's rows, no more than are likely to be needed go to the driver
        sizes = [r["n"] for r in rows.select("n", *order).orderBy(*order).limit(most).collect()]
        ends = list(accumulate(sizes))
        if len(sizes) < most or ends[-1] >= SAMPLE_BYTES:
            break
        most *= 4
    taken = sum(e - n < SAMPLE_BYTES for e, n in zip(ends, sizes))
    return train([bytes(r["v"]) for r in rows.orderBy(*order).limit(taken).select("v").collect()])


def _map(df: DataFrame, column: str, into: str, symbols: list[bytes], coder: str) -> DataFrame:
    """df with a column of coded values; null stays null. Batches are bounded in bytes."""
    shared, at = df.sparkSession.sparkContext.broadcast(symbols), df.columns.index(column)  # 255 of 8 bytes
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        code = getattr(Table(shared.value), coder)
        for b in batches:
            given = b.column(at).to_pylist()
            done = code([v.encode() if isinstance(v, str) else v or b"" for v in given])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if v is None else x for v, x in zip(given, done)], pa.binary())], names=[*b.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))


def encode(df: DataFrame, column: str, table: Table, into: str = "coded") -> DataFrame:
    return _map(df, column, into, table.symbols, "encode_all")


def decode(df: DataFrame, column: str, table: Table, into: str = "decoded") -> DataFrame:
    return _map(df, column, into, table.symbols, "decode_all")


def dictionary(table: Table) -> list[tuple[int, int, bytes]]:
    """(code, length, symbol) rows."""
    return [(i, len(s), s) for i, s in enumerate(table.symbols)]


def ratio(df: DataFrame, raw: str, coded: str) -> DataFrame:
    return df.agg((F.sum(F.octet_length(coded)) / F.sum(F.octet_length(F.col(raw).cast("binary")))).alias("ratio"))

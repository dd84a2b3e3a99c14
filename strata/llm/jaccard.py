"""Exact Jaccard join of documents by their sets of word shingles, and its connected components.

Documents with equal sets are one node. Nodes meet in tiles: a tile is a shingle and a band of sizes in
which the smaller set has at least 3/4 of the larger one's size. A node enters the tiles of the first
quarter of its shingles in an order that all share (shingles common in the corpus last, else by hash):
two sets that reach the threshold share one of these, by the prefix principle, and the smaller one
shares one of its first seventh. In a tile, hashed bitmaps are compared first: the bits that one set has
and the other lacks bound the overlap from above. Pairs that pass are settled by the intersection of
the sorted arrays of 64-bit shingle hashes.

A tile is a star first: each of its sets is compared with the smallest one of its band, which settles
tiles of two sets. Components of these links then leave few tiles with more than one component, and only
pairs of different components are compared in those, so a large group of near copies costs in proportion
to its size, and no link between two components is lost. Stars are streamed in order of shingle and size,
those of a shingle in very many sets as several stars; tiles with more than one component are cut into
cells of two blocks of at most BLOCK sets or so, in which bitmaps are compared in place, so that only
pairs which may be linked leave a task.

Sets are told apart by 64-bit hashes of their shingles' hashes and their size.

Edge cases: null texts and texts without words have an empty set, linked with nothing; fewer than five
words are one shingle; repeated rows and copies share a component; a null id has no component and links
nothing; very long texts are whole; an empty table gives an empty one; other columns are ignored, or
kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_batches, mix, runs, written
from .graph import HEAVY, components, copies, heavy_keys, lookup, spread

WORDS = 5
COMMON = 65_536  # shingles that are put last, the commonest
LOCALLY_COMMON = 3  # times in FLUSH shingles or so of a task, to be looked at
FLUSH = 2_000_000
SEEN = 100_000  # sets that a task knows to have been there
PART = 40  # bits of a code below the part
BLOCK = 2_048  # sets of a tile that are compared with as many others in one place
LEAST_BITS = 2_048  # of a bitmap: the finer it is, the fewer pairs below the threshold it lets pass
MARKS = 1 << 24  # bits by which texts to be verified are known
SHORT = 256  # bytes of the bitmaps that travel with tiles

_K = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))  # a number for each byte
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CUT = 1 << 18  # bytes that are hashed at once, or one longer word
_SPACES = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lower-cased bytes begins, and its hash (unsigned 64 bit): a polynomial of its bytes' numbers,
    from running sums, so no Python runs for a word."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    up, down = _powers(_BASE, CUT), _powers(_INVERSE, CUT)
    while at < len(data):
        end = min(at + CUT, len(data))
        if end < len(data):  # back to white space, or on to it behind a longer word
            back = max(data.rfind(w, at, end) for w in _SPACES)
            end = back + 1 if back >= at else min((x + 1 for w in _SPACES if (x := data.find(w, end)) >= 0), default=len(data))
        block = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_WHITE[block]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        s, e = edge[::2], edge[1::2]
        if len(block) > len(up):
            up, down = _powers(_BASE, len(block)), _powers(_INVERSE, len(block))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[block] * up[: len(block)])])
        starts.append(s + at)
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (unsigned 64 bit) of each text."""
    return [s for run in runs(texts) for s in _sets(run, words)]


def _sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    found = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    starts, h = word_hashes(b" ".join(found))
    ends = np.cumsum([len(f) + 1 for f in found])
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    n = len(h) - words + 1
    rolled = np.full(max(n, 0), words, np.uint64)
    for i in range(words):
        rolled = mix(rolled * _K + h[i : i + n]) if n > 0 else rolled
    out, at = [], 0
    for size in sizes.tolist():
        if size >= words:
            own = np.sort(rolled[at : at + size - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif size:
            x = np.array([size], np.uint64)
            for v in h[at : at + size]:
                x = mix(x * _K + v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def set_hash(s: np.ndarray) -> int:
    """A hash of a set, signed 64 bit."""
    with np.errstate(over="ignore"):
        x = np.uint64(len(s)) * _K + np.add.reduce(mix(s)) + mix(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
        return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set: 4 or more for each shingle, a power of two of them, LEAST_BITS at least."""
    size = max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """Shingles that two sets share at most, by their bitmaps."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def folded(bits: bytes, size: int = SHORT) -> bytes:
    """A bitmap cut to a size at most, by OR of its halves."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x.tobytes()


def near_in_cell(n: np.ndarray, sid: np.ndarray, small: np.ndarray, c: np.ndarray, side: np.ndarray, bits: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of rows (the smaller set first) of different components, and of different sides if there are two, whose
    bitmaps allow a link."""
    order = np.lexsort((sid, n))
    n, sid, small, c, side = n[order], sid[order], small[order], c[order], side[order]
    two, out = side.min() != side.max(), []
    width = np.array([len(bits[i]) for i in order])
    matrix = {w: np.frombuffer(b"".join(bits[i] for i in order[width == w]), np.uint64).reshape(-1, w // 8) for w in np.unique(width)}
    place = np.zeros(len(n), np.int64)
    for w in matrix:
        place[width == w] = np.arange((width == w).sum())
    for y in range(1, len(n)):
        lo = int(np.searchsorted(n[:y], -(-3 * int(n[y]) // 4)))
        x = lo + np.flatnonzero(small[lo:y] & (c[lo:y] != c[y]) & (sid[lo:y] != sid[y]))
        if two:
            x = x[side[x] != side[y]]
        if not len(x):
            continue
        own = matrix[width[y]][place[y]]
        while len(own):
            at = x[width[x] == 8 * len(own)]
            if len(at):
                m = matrix[8 * len(own)][place[at]]
                most = np.minimum(n[at] - np.bitwise_count(m & ~own).sum(axis=1, dtype=np.int64), n[y] - np.bitwise_count(own & ~m).sum(axis=1, dtype=np.int64))
                at = at[100 * most >= 75 * (n[at] + n[y] - most)]
                out += [(int(sid[k]), int(sid[y])) for k in at]
            own = own[: len(own) // 2] | own[len(own) // 2 :] if len(own) > 1 else own[:0]
    return out


def linked(na: int, nb: int, both: int) -> bool:
    return 100 * both >= 75 * (na + nb - both)


def prefix(n: int) -> tuple[int, int]:
    """How many first shingles a set of n puts into tiles as the larger of two sets, and as the smaller."""
    return n + (-3 * n // 4) + 1, n + (-6 * n // 7) + 1


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of k, sid, n, bits and short (bits, folded) for each document, and rows of sid (a shingle) and n (how often) for shingles common in a task."""
    schema = pa.schema([("k", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("short", pa.binary())])

    def run(batches):
        many, held, seen = [], 0, set()
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            sids = [set_hash(s) for s in sets]
            bits = [bitmap(s) if len(s) else None for s in sets]
            yield _batch([b.column(0), sids, [len(s) for s in sets], bits, [x and folded(x) for x in bits]], schema)
            for s, sid in zip(sets, sids):
                if sid not in seen:  # copies say nothing about how common a shingle is
                    seen.add(sid)
                    many.append(s)
                    held += len(s)
            if held > FLUSH:
                yield common(many)
                many, held, seen = [], 0, set()
        if many:
            yield common(many)

    def common(many):
        value, n = np.unique(np.concatenate(many), return_counts=True)
        on = n >= LOCALLY_COMMON
        return _batch([[None] * int(on.sum()), value[on].view(np.int64), n[on], *[[None] * int(on.sum())] * 2], schema)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null").transform(in_batches, run, "k long, sid long, n long, bits binary, short binary")


def tile_rows(docs: DataFrame, common: np.ndarray, parts: np.ndarray, text: str = "text") -> DataFrame:
    """tile, sid and code of each set: the star's part (0 for tiles of one star), n and, in the last bit, 0 if it is small
    (may be the smaller set too), so that of equal sizes these come first. common: shingles to put last, the commonest at the end; parts: how many stars each of them makes."""
    schema = pa.schema([("tile", pa.int64()), ("sid", pa.int64()), ("code", pa.int64())])
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order + 1, parts[order]))  # COMMON numbers, three times

    def run(batches):
        names, ranks, stars = shared.value
        seen = set()
        for b in batches:
            tiles, sids, codes = [], [], []
            for s in shingle_sets(b.column(0).to_pylist()):
                n, sid = len(s), set_hash(s)
                if not n or sid in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(sid)
                own = np.zeros(n, np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    last = np.where(names[at] == s, ranks[at], 0)
                    if last.any():
                        own = np.where((last > 0) & (stars[at] > 1), 1 + sid % stars[at], 0)
                        by = np.argsort(last, kind="stable")
                        s, own = s[by], own[by]
                p, q = prefix(n)
                tiles.append(s[:p])
                sids.append(np.full(p, sid))
                codes.append(own[:p] << PART | n << 1 | (np.arange(p) >= q))
            if tiles:
                yield _batch([np.concatenate(tiles).view(np.int64), np.concatenate(sids), np.concatenate(codes)], schema)

    return docs.select(F.col(text)).transform(in_batches, run, "tile long, sid long, code long")


def stars(rows: DataFrame) -> DataFrame:
    """Rows of tiles with three sets or more, or of several parts (tile, sid, n, small), and pairs (sid, other) of a set
    and the first of its band and part; tile is null for these. Two sets of a tile of one part are settled by their pair."""
    schema = pa.schema([("tile", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("small", pa.bool_()), ("other", pa.int64())])

    def run(batches):
        now, last, head, held, split = None, None, None, [], False
        pairs: set[tuple[int, int]] = set()
        for b in batches:
            t, code = b.column(0).to_numpy(), b.column(1).to_numpy()
            p = code >> PART
            same = (t[1:] == t[:-1]) & (p[1:] == p[:-1])
            on = np.concatenate([[True], same]) | np.concatenate([same, [True]]) | (p > 0)  # more than one row, at an end, or split
            n, small = (code[on] & (1 << PART) - 1) >> 1, code[on] & 1 == 0
            out: list[tuple[int, int, int, bool]] = []
            for tile, part, sid, n, small in zip(t[on].tolist(), p[on].tolist(), b.column(2).to_numpy()[on].tolist(), n.tolist(), small.tolist()):
                if (tile, part) != now:
                    now, last, head, held, split = (tile, part), sid, (n, sid) if small else None, [(tile, sid, n, small)], part > 0
                elif sid != last:
                    last = sid
                    held.append((tile, sid, n, small))
                    if head and 4 * head[0] >= 3 * n:
                        pairs.add((head[1], sid))
                    else:
                        head = (n, sid) if small else None
                else:
                    continue
                if split or len(held) > 2:
                    out += held
                    held, split = [], True
            if out:
                yield _batch([*zip(*out), [None] * len(out)], schema)
            if len(pairs) > SEEN:
                yield told(pairs)
                pairs = set()
        if pairs:
            yield told(pairs)

    def told(pairs):
        n = len(pairs)
        return _batch([[None] * n, [p[0] for p in pairs], [None] * n, [None] * n, [p[1] for p in pairs]], schema)

    dealt = rows.repartition(F.col("tile"), F.shiftright("code", PART)).sortWithinPartitions("tile", "code", "sid").select("tile", "code", "sid")
    return dealt.transform(in_batches, run, "tile long, sid long, n int, small boolean, other long")


def between(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b of sets of different components in one tile whose bitmaps allow a link. rows: tile, sid, n, small, c."""
    mixed = rows.groupBy("tile").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 <> c1")
    mixed = written(mixed.select("tile", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), "m"), "mixed")
    heavy = heavy_keys(mixed, "tile", "m")
    left = spread(rows, "tile", heavy, "sid").join(copies(mixed, "tile", heavy), ["tile", "salt"]).withColumn("side", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    full = left.join(nodes.select("sid", "short"), "sid")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = full.withColumn("other", other).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    dealt = cells.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").select("tile", "i", "j", "sid", "n", "small", "c", "side", "short")

    def run(batches):
        now, held, pairs = None, [], set()
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns)):
                if row[:3] != now:
                    pairs.update(cell(held))
                    now, held = row[:3], []
                    if len(pairs) > SEEN:
                        yield told(pairs)
                        pairs = set()
                held.append(row[3:])
        pairs.update(cell(held))
        if pairs:
            yield told(pairs)

    def cell(held):
        if len(held) < 2 or len({r[3] for r in held}) < 2:
            return []
        sid, n, small, c, side, bits = zip(*held)
        return near_in_cell(np.array(n, np.int64), np.array(sid, np.int64), np.array(small), np.array(c, np.int64), np.array(side), list(bits))

    def told(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    out = written(dealt.transform(in_batches, run, "a long, b long").distinct(), "between")
    discard(mixed)
    return out


def _marks(keys: DataFrame) -> np.ndarray:
    """Which of MARKS hashes any key has: a bitmap of a fixed size. Texts whose id's hash is not there are not wanted, so
    texts are filtered where they are; one that is there by chance is dropped by the join that follows."""
    h = F.pmod(F.xxhash64("k"), F.lit(MARKS)) + 1  # positions in bitmaps are counted from 1
    parts = keys.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    return out


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs (a, b: ids of nodes) that reach the threshold. nodes: sid, k, n, bits."""
    side = lambda x: nodes.select(F.col("sid").alias(x), F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "ka", "na", "bitsa", "b", "kb", "nb", "bitsb")

    def bound(batches):
        for b in batches:
            na, ba, nb, bb = (b.column(i).to_pylist() for i in (2, 3, 6, 7))
            on = [linked(x, y, overlap_bound(x, p, y, q)) for x, p, y, q in zip(na, ba, nb, bb)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 4, 5)], names=["a", "ka", "b", "kb"]).filter(pa.array(on, pa.bool_()))

    near = written(both.transform(in_batches, bound, "a long, ka long, b long, kb long"), "near")  # of ids
    marks = docs.sparkSession.sparkContext.broadcast(_marks(near.select(F.col("ka").alias("k")).union(near.select("kb"))))
    own = docs.select(F.col(key).cast("long").alias("k"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(MARKS)).cast("int").alias("mark"), F.col(text).alias("t")).where("k is not null")

    def sets(batches):
        known = marks.value
        for b in batches:
            at = b.column(1).to_numpy()
            b = b.filter(pa.array(known[at >> 3] >> (at & 7) & 1 > 0))
            found = shingle_sets(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "s"])

    wanted = near.select(F.col("a").alias("sid")).union(near.select("b")).distinct()
    arrays = written(own.transform(in_batches, sets, "sid long, s binary").join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    paired = near.join(arrays.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(arrays.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")

    def exact(batches):
        for b in batches:
            on = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                on.append(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    links = written(paired.select("ka", "kb", "sa", "sb").transform(in_batches, exact, "a long, b long"), "links")
    discard(near, arrays)
    return links


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest id reachable by links, its own included) of each row."""
    told = written(signatures(docs, key, text), "signatures")
    own = told.where("k is not null")
    nodes = written(own.where("n > 0").groupBy("sid", "n").agg(F.min("k").alias("k"), F.first("bits").alias("bits"), F.first("short").alias("short"), F.count("*").alias("rows")), "nodes")
    top = told.where("k is null").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(COMMON).collect()[::-1]
    common, often = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    several = often > max(BLOCK, nodes.count() // HEAVY)  # shingles in many sets are stars of BLOCK sets or so

    rows = tile_rows(docs.where(F.col(key).isNotNull()), common, np.where(several, -(-often // BLOCK), 1), text)
    tiles = written(stars(rows), "tiles")
    pairs = written(tiles.where("tile is null").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    near = verify(pairs, nodes, docs, key, text)
    first = components(near)

    label = written(nodes.select("sid", "n", "k").join(first.withColumnRenamed("node", "k"), "k", "left").select("sid", "n", "k", F.coalesce("component", "k").alias("c")), "labels")
    rows = written(tiles.where("tile is not null").select("tile", "sid", "n", "small").join(label.select("sid", "c"), "sid"), "rows")
    discard(tiles, near)
    rest = between(rows, nodes)
    more = verify(rest.join(pairs, ["a", "b"], "left_anti"), nodes, docs, key, text)
    discard(rows, pairs)
    # what is left are links between components, which become nodes
    of = lambda end: first.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    between_them = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    final = components(between_them)
    discard(rest, more, first)

    heavy = heavy_keys(nodes, "sid", "rows")
    by_set = lookup(label, "c", final.select(F.col("node").alias("c"), "component"), "sid").select("sid", F.col("n").alias("m"), F.coalesce("component", "c").alias("component_id"))
    left, right = spread(own.select("k", "sid", "n"), "sid", heavy, "k"), copies(by_set, "sid", heavy)
    same = (left["sid"] == right["sid"]) & (left["n"] == right["m"]) & (left["salt"] == right["salt"])
    found = left.join(right, same, "left").select("k", "n", F.coalesce("component_id", "k").alias("component_id"))
    lost = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("component_id"))
    return found.union(lost).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id. Each text of an id that comes with several is
    a document of its own, repeated rows are one. All columns stay; rows without an id stay."""
    some, lost = docs.where(F.col(key).isNotNull()), docs.where(F.col(key).isNull())
    told = F.xxhash64(F.col(text))
    at = key
    if not some.groupBy(key).agg(F.min(told).alias("lo"), F.max(told).alias("hi")).where("lo <> hi").isEmpty():
        at = "row"
        while at.lower() in {c.lower() for c in docs.columns}:
            at += "_"
        # numbers of the texts in order of their ids; of a range of ids each, so no task has all
        texts = written(some.select(F.col(key).alias("i"), told.alias("h")).distinct().orderBy("i", "h").withColumn("u", F.monotonically_increasing_id()), "texts")
        some = written(some.join(texts, (some[key] == texts["i"]) & (told == texts["h"])).select(F.col("u").alias(at), *[some[c] for c in docs.columns]), "numbered")
    gone = join(some, at, text).where("component_id <> " + f"`{at}`").select(at)
    return some.join(gone.distinct(), at, "left_anti").dropDuplicates([at]).select(*docs.columns).union(lost)

"""Queries over the store's operators and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, flags, fsst
from ..functions.bounds import Range, key_filter, overlaps
from ..operators import levels, ranges, sequences, versions
from ..scratch import folder
from ..sources import frames, segments
from ..streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shape(events: DataFrame) -> DataFrame:
    tomb = F.when(F.col("event_type") == "error", 8).otherwise(0)
    return events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("ver"), F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long").alias("wal_id"),
        F.octet_length("props").cast("long").alias("len"), (tomb + F.col("event_id") % 8).cast("int").alias("flag"),
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(_table(spark, sf_dir, "events"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two layers: the later half of the versions is layer 0."""
    log = _log(spark, sf_dir)
    middle = (log.agg(F.max("ver")).first()[0] or 0) // 2
    return log.withColumn("layer", F.when(F.col("ver") > middle, 0).otherwise(1))


LOG = """WITH log AS (SELECT user_id AS key, event_id AS ver, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS wal_id, strlen(props)::BIGINT AS len,
  ((CASE WHEN event_type = 'error' THEN 8 ELSE 0 END) + event_id % 8)::INTEGER AS flag FROM events),
layers AS (SELECT *, (CASE WHEN ver > (SELECT max(ver) // 2 FROM log) THEN 0 ELSE 1 END)::INTEGER AS layer FROM log),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ver DESC) = 1)
"""


@query(LOG + "SELECT * FROM newest WHERE flag & 8 = 0")
def kv_get_latest(spark, sf_dir):
    return versions.live(versions.latest(_log(spark, sf_dir)))


@query("SELECT c_custkey AS key, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS ver FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def kv_multi_get_hit(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    log = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ver"))
    return versions.latest(versions.multi_get(log, keys))


@query("SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def kv_multi_get_miss(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return versions.missing(_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct(), keys)


@query("SELECT o_orderkey AS key, o_custkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS rank FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 3000")
def kv_range_scan(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey").where(key_filter(F.col("key"), 1000, 3000))
    return versions.numbered(df, ("key",)).select("key", "o_custkey", (F.col("n") + 1).alias("rank"))


@query("SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey DESC)::BIGINT AS rank FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= 9000 QUALIFY rank <= 25")
def kv_rev_range_topk(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).where(key_filter(F.col("key"), 1000, 9000, False, True)).orderBy(F.desc("key")).limit(25)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("key"))).cast("long"))  # 25 rows


_KINDS = (("included", True), ("excluded", False), ("open", None))
_BOUNDS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS lo_kind, '{b}' AS hi_kind, count(*)::BIGINT AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part WHERE "
    + {True: "p_partkey >= 50", False: "p_partkey > 50", None: "true"}[x] + " AND " + {True: "p_partkey <= 150", False: "p_partkey < 150", None: "true"}[y]
    for a, x in _KINDS for b, y in _KINDS
)


@query(_BOUNDS_SQL)
def kv_bounds_matrix(spark, sf_dir):
    key, cases = F.col("p_partkey"), []
    for a, x in _KINDS:
        for b, y in _KINDS:
            on = key_filter(key, None if x is None else 50, None if y is None else 150, bool(x), bool(y))
            k = F.when(on, key)
            cases.append(F.struct(F.lit(a).alias("lo_kind"), F.lit(b).alias("hi_kind"), F.count(k).alias("n"), F.min(k).alias("first"), F.max(k).alias("last")))
    return _table(spark, sf_dir, "part").agg(F.array(*cases).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query(LOG + "SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, ver DESC) = 1")
def kv_merge_layers(spark, sf_dir):
    log = _layers(spark, sf_dir)
    return versions.merge(log.where("layer = 0").drop("layer"), log.where("layer = 1").drop("layer"))


@query(LOG + "SELECT * FROM newest")
def kv_tombstone_raw(spark, sf_dir):
    return versions.latest(_log(spark, sf_dir))


@query(LOG + "SELECT * FROM newest WHERE flag & 8 = 0")
def kv_tombstone_live(spark, sf_dir):
    return versions.live(versions.latest(_log(spark, sf_dir)))


@query(LOG + "SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY layer, key ORDER BY ver DESC) > 1")
def kv_discards(spark, sf_dir):
    return versions.discards(_layers(spark, sf_dir))


@query(LOG + ", d AS (SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY layer, key ORDER BY ver DESC) > 1) SELECT wal_id, count(*)::BIGINT AS n, sum(len)::BIGINT AS bytes FROM d GROUP BY wal_id")
def kv_discard_bytes_by_wal(spark, sf_dir):
    return versions.discards(_layers(spark, sf_dir)).groupBy("wal_id").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@query(LOG + "SELECT layer, count(DISTINCT key)::BIGINT AS keys, sum(strlen(key::VARCHAR) + 64)::BIGINT AS bytes FROM layers GROUP BY layer")
def mem_size(spark, sf_dir):
    return _layers(spark, sf_dir).groupBy("layer").agg(F.countDistinct("key").alias("keys"), F.sum(versions.entry_bytes(F.col("key"))).cast("long").alias("bytes"))


@query("SELECT DISTINCT p_partkey % 16 AS flag, p_partkey & 8 <> 0 AS tombstone, p_partkey & 4 <> 0 AS in_own_file, p_partkey & 4 = 0 AS infile, p_partkey & 3 IN (1, 2) AS compressed, p_partkey & 3 AS codec, (p_partkey % 16) | 8 AS set_tombstone, p_partkey & 7 AS storage, (p_partkey & 12) | 1 AS as_lz4, (p_partkey & 12) | 2 AS as_zstd, (p_partkey & 12) | 3 AS as_solid FROM part")
def flag_matrix(spark, sf_dir):
    f = F.col("flag")
    return _table(spark, sf_dir, "part").select((F.col("p_partkey") % 16).alias("flag")).distinct().select(
        "flag", flags.is_tombstone(f).alias("tombstone"), flags.is_file(f).alias("in_own_file"), flags.is_infile(f).alias("infile"), flags.is_compressed(f).alias("compressed"), flags.codec(f).alias("codec"),
        flags.with_tombstone(f).alias("set_tombstone"), flags.storage(f).alias("storage"), *[flags.with_codec(f, c).alias(n) for c, n in ((1, "as_lz4"), (2, "as_zstd"), (3, "as_solid"))],
    )


def _sorted_segments(spark, sf_dir) -> DataFrame:
    return ranges.zone_map(_table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("seg"), "o_orderkey"), "seg", "o_orderkey")


def _ranges(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        k.alias("rid"), F.when(k % 8 != 7, k * 7).alias("lo"), (k % 4 < 2).alias("lo_inc"), F.when(k % 16 != 6, k * 7 + 50).alias("hi"), (k % 2 == 0).alias("hi_inc")
    )


SEG = """WITH segs AS (SELECT o_orderkey // 100 AS seg, min(o_orderkey) AS min, max(o_orderkey) AS max, count(*)::BIGINT AS n FROM orders GROUP BY 1),
l0 AS (SELECT o_custkey % 8 AS seg, min(o_orderkey) AS min, max(o_orderkey) AS max FROM orders GROUP BY 1),
q AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 8 <> 7 THEN c_custkey * 7 END AS lo, c_custkey % 4 < 2 AS lo_inc, CASE WHEN c_custkey % 16 <> 6 THEN c_custkey * 7 + 50 END AS hi, c_custkey % 2 = 0 AS hi_inc FROM customer)
"""
_OVER = "(lo IS NULL OR max > lo OR (max = lo AND lo_inc)) AND (hi IS NULL OR min < hi OR (min = hi AND hi_inc))"


@query(SEG + "SELECT * FROM segs")
def seg_zone_map(spark, sf_dir):
    return _sorted_segments(spark, sf_dir)


@query(SEG + "SELECT c_custkey * 7 AS key, seg FROM customer JOIN segs ON c_custkey * 7 BETWEEN min AND max")
def seg_contains(spark, sf_dir):
    key, yes = F.col("c_custkey") * 7, F.lit(True)
    points = _table(spark, sf_dir, "customer").select(key.alias("key"), key.alias("lo"), yes.alias("lo_inc"), key.alias("hi"), yes.alias("hi_inc"))
    return ranges.overlap_bucketed(points, _sorted_segments(spark, sf_dir), 1000).select("key", "seg")


@query(SEG + f"SELECT rid, seg FROM q JOIN l0 ON {_OVER}")
def overlap_l0(spark, sf_dir):
    files = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("seg"), "o_orderkey")
    return ranges.overlap(_ranges(spark, sf_dir), ranges.zone_map(files, "seg", "o_orderkey")).select("rid", "seg")


@query(SEG + f"SELECT rid, count(*)::BIGINT AS n, min(seg) AS first, max(seg) AS last FROM q JOIN segs ON {_OVER} GROUP BY rid")
def overlap_sorted(spark, sf_dir):
    found = ranges.overlap_bucketed(_ranges(spark, sf_dir), _sorted_segments(spark, sf_dir), 1000)
    return found.groupBy("rid").agg(F.count("*").alias("n"), F.min("seg").alias("first"), F.max("seg").alias("last"))


#: Pairs of ranges (lo, lo_inc, hi, hi_inc) and whether they overlap.
OVERLAPS = (
    (1, True, 10, False, 5, True, 15, False, True), (1, True, 10, False, 10, True, 20, False, False), (1, True, 10, True, 10, True, 20, True, True),
    (1, True, 10, True, 10, True, 15, False, True), (1, True, 10, False, 10, True, 15, True, False), (None, True, 10, False, 10, True, 20, False, False),
    (5, True, None, False, 1, True, 5, False, False), (5, True, None, False, 1, True, 5, True, True), (None, False, None, False, 3, True, 4, False, True),
    (5, True, 5, False, 5, True, 5, False, False), (5, True, 5, False, 1, True, 10, False, True), (5, True, 5, True, 1, True, 10, False, True),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {r[8]})" for i, r in enumerate(OVERLAPS)) + ") v(id, found)")
def overlap_bounds(spark, sf_dir):
    kind = "id long, alo long, alo_inc boolean, ahi long, ahi_inc boolean, blo long, blo_inc boolean, bhi long, bhi_inc boolean"
    df = spark.createDataFrame([(i, *r[:8]) for i, r in enumerate(OVERLAPS)], kind)
    return df.select("id", overlaps(Range.of("a"), Range.of("b")).alias("found"))


@query(SEG + "SELECT seg, min, max FROM (SELECT *, lag(max) OVER (ORDER BY min) AS before FROM segs) WHERE before >= min")
def seg_disjoint_check(spark, sf_dir):
    return ranges.disjoint_violations(_sorted_segments(spark, sf_dir).drop("n"))


def _leveled(spark, sf_dir) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    size, rmed = F.count("*") * 1_000_000, F.sum(F.when(F.col("l_returnflag") == "R", 1_000_000).otherwise(0))
    return items.groupBy(F.col("l_suppkey").alias("id")).agg(size.cast("long").alias("size"), rmed.cast("long").alias("rmed")).withColumn("level", (F.col("id") % 7).cast("int"))


LEV = """WITH s AS (SELECT l_suppkey AS id, (l_suppkey % 7)::INTEGER AS level, (count(*) * 1000000)::BIGINT AS size, (count(*) FILTER (l_returnflag = 'R') * 1000000)::BIGINT AS rmed FROM lineitem GROUP BY 1, 2),
z AS (SELECT level, count(*)::BIGINT AS files, sum(size + rmed)::BIGINT AS actual FROM s GROUP BY level),
total AS (SELECT coalesce(sum(actual), 0)::BIGINT AS total FROM z),
t0 AS (SELECT l::INTEGER AS level, CASE WHEN l = 0 THEN 0 WHEN l = 6 OR total // (8::BIGINT ** (6 - l))::BIGINT >= 268435456 THEN total // (8::BIGINT ** (6 - l))::BIGINT ELSE 0 END::BIGINT AS target FROM total, range(7) r(l)),
t1 AS (SELECT level, coalesce(files, 0)::BIGINT AS files, coalesce(actual, 0)::BIGINT AS actual, target, (SELECT coalesce(min(level), 6) FROM t0 WHERE target > 0 AND level > 0)::INTEGER AS target_base FROM t0 LEFT JOIN z USING (level)),
t AS (SELECT *, coalesce((SELECT min(level) FROM t1 WHERE actual > 0 AND level > 0 AND level < target_base), target_base)::INTEGER AS base FROM t1),
sc AS (SELECT *, (CASE WHEN level = 0 THEN CASE WHEN files > 8 THEN 4294967295 ELSE files * 128 // 4 END WHEN target = 0 THEN CASE WHEN actual > 0 THEN 4294967295 ELSE 0 END ELSE least(actual * 128 // target, 4294967294) END)::BIGINT AS score FROM t WHERE level < 6),
fs AS (SELECT *, (CASE WHEN size = 0 THEN 4294967295 ELSE rmed * 128 // size END)::BIGINT AS score FROM s)
"""


@query(LEV + "SELECT * FROM z")
def level_sizes(spark, sf_dir):
    return levels.level_sizes(_leveled(spark, sf_dir))


@query(LEV + "SELECT level, target FROM t0 WHERE level > 0")
def level_targets(spark, sf_dir):
    total = levels.level_sizes(_leveled(spark, sf_dir)).agg(F.coalesce(F.sum("actual"), F.lit(0)).cast("long").alias("total"))
    return levels.level_targets(total)


@query(LEV + "SELECT level, target_base, base FROM t")
def base_level(spark, sf_dir):
    return levels.level_table(_leveled(spark, sf_dir)).select("level", "target_base", "base")


@query(LEV + "SELECT level, files, actual, target, score FROM sc")
def level_scores(spark, sf_dir):
    return levels.level_scores(_leveled(spark, sf_dir)).select("level", "files", "actual", "target", "score")


@query(LEV + "SELECT id, level, score, row_number() OVER (PARTITION BY level ORDER BY score DESC, id DESC)::BIGINT AS rank FROM fs")
def file_scores(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), F.desc("id")))
    return levels.file_scores(_leveled(spark, sf_dir)).select("id", "level", "score", rank.cast("long").alias("rank"))


@query(LEV + """, top AS (SELECT * FROM sc WHERE score >= 128 ORDER BY score DESC, level DESC LIMIT 1)
SELECT level AS from_level, (CASE WHEN level < base THEN base ELSE level + 1 END)::INTEGER AS to_level, CASE WHEN level > 0 THEN (SELECT id FROM fs WHERE fs.level = top.level ORDER BY fs.score DESC, id DESC LIMIT 1) END AS id FROM top""")
def compaction_pick(spark, sf_dir):
    return levels.compaction_pick(_leveled(spark, sf_dir))


@query("SELECT user_id AS id, event_id AS seq FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def manifest_replay(spark, sf_dir):
    ops = _table(spark, sf_dir, "events").where("event_type <> 'purchase'").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("add"))
    return levels.replay(ops).select("id", "seq")


@query(LOG + "SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, ver DESC) = 1")
def compact_merge(spark, sf_dir):
    """Both layers as one; tombstones stay, as older rows may lie below."""
    log = _layers(spark, sf_dir)
    return versions.compact(versions.merge(log.where("layer = 0").drop("layer"), log.where("layer = 1").drop("layer")), deepest=False)


@query(LOG + "SELECT * FROM newest WHERE flag & 8 = 0")
def compact_bottom(spark, sf_dir):
    return versions.compact(versions.latest(_log(spark, sf_dir)), deepest=True)


@query("SELECT event_id // 50 AS segment, count(*)::BIGINT AS n, (count(*) * 72)::BIGINT AS bytes, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def rotate_segments(spark, sf_dir):
    """Entries of 8-byte keys of one writer; a segment that has reached 3,600 bytes is closed before the next entry."""
    log = versions.numbered(_log(spark, sf_dir), ("ver",))
    entries = -(-3600 // (8 + versions.ENTRY_OVERHEAD))
    return log.groupBy(F.expr(f"n div {entries}").alias("segment")).agg(F.count("*").alias("n"), (F.count("*") * 72).alias("bytes"), F.min("ver").alias("first"), F.max("ver").alias("last"))


@query("""WITH RECURSIVE e AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS wal_id, event_id AS ver, (strlen(user_id::VARCHAR) + 64)::BIGINT AS b FROM events),
l AS (SELECT wal_id, list({'ver': ver, 'held': b, 'seg': 0::BIGINT, 'b': b} ORDER BY ver) AS x FROM e GROUP BY wal_id),
n AS (SELECT wal_id, x, len(x) AS size FROM l),
r AS (
  SELECT wal_id, 1 AS i, x[1].b AS held, 0::BIGINT AS seg, x[1].ver AS ver, x[1].b AS b FROM n
  UNION ALL SELECT r.wal_id, i + 1, CASE WHEN held >= 1000 THEN x[i + 1].b ELSE held + x[i + 1].b END, CASE WHEN held >= 1000 THEN seg + 1 ELSE seg END, x[i + 1].ver, x[i + 1].b FROM r JOIN n ON r.wal_id = n.wal_id AND i < size)
SELECT wal_id, seg AS segment, count(*)::BIGINT AS n, sum(b)::BIGINT AS bytes, min(ver)::BIGINT AS first, max(ver)::BIGINT AS last FROM r GROUP BY wal_id, seg""")
def rotate_by_bytes(spark, sf_dir):
    """Each writer's log in segments of 1,000 bytes of entries, whose keys are of several lengths."""
    return versions.rotated(_log(spark, sf_dir), "wal_id", ("ver",), versions.entry_bytes(F.col("key")), 1000)


def _seq(spark, sf_dir) -> DataFrame:
    """pos and val (the characters so far) of documents in order of their ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") + 1).alias("v"))
    return versions.running(docs, ("doc_id",), F.col("v"), "val", "pos").select("pos", "val")


def _targets(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 1777).alias("t"))


SEQ = """WITH seq AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, (sum(n_chars + 1) OVER (ORDER BY doc_id))::BIGINT AS val FROM documents),
targets AS (SELECT c_custkey * 1777 AS t FROM customer),
dup AS (SELECT l_orderkey AS val, row_number() OVER (ORDER BY l_orderkey) - 1 AS pos FROM lineitem)
"""


@query(SEQ + "SELECT pos, val FROM seq JOIN customer ON pos = c_custkey * 3")
def seq_get(spark, sf_dir):
    return _seq(spark, sf_dir).join(_table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("pos")), "pos")


@query(SEQ + "SELECT t, pos, val FROM targets ASOF JOIN seq ON t <= val")
def seq_next_ge(spark, sf_dir):
    return sequences.next_ge(_seq(spark, sf_dir), _targets(spark, sf_dir))


@query(SEQ + "SELECT t, pos, val FROM targets ASOF JOIN seq ON t > val")
def seq_prev_lt(spark, sf_dir):
    return sequences.prev_lt(_seq(spark, sf_dir), _targets(spark, sf_dir))


@query(SEQ + "SELECT pos, val FROM seq WHERE val >= 100000 AND val < 900000")
def seq_range(spark, sf_dir):
    return _seq(spark, sf_dir).where("val >= 100000 and val < 900000")


@query(SEQ + "SELECT pos, val, row_number() OVER (ORDER BY val DESC)::BIGINT AS rank FROM seq WHERE val >= 100000 AND val < 900000")
def seq_rev_range(spark, sf_dir):
    part = _seq(spark, sf_dir).where("val >= 100000 and val < 900000")
    return versions.numbered(part.withColumn("back", -F.col("val")), ("back",)).select("pos", "val", (F.col("n") + 1).alias("rank"))


@query(SEQ + ", steps AS (SELECT c_custkey AS step, max(c_custkey * 1777 % 500009) OVER (ORDER BY c_custkey) AS t FROM customer) SELECT step, t, pos, val FROM steps ASOF JOIN seq ON t <= val")
def seq_seek(spark, sf_dir):
    """A cursor that only moves forward: each step seeks the largest target so far."""
    customer = _table(spark, sf_dir, "customer")
    steps = customer.select(F.col("c_custkey").alias("step"), (F.col("c_custkey") * 1777 % 500009).alias("v"))
    steps = versions.running_max(steps, ("step",), F.col("v"), "t").select("step", "t")
    return steps.join(sequences.next_ge(_seq(spark, sf_dir), steps), "t").select("step", "t", "pos", "val")


@query(SEQ + "SELECT pos // 128 AS chunk, count(*)::BIGINT AS n, min(val) AS min, max(val) AS max FROM seq GROUP BY 1")
def seq_chunks(spark, sf_dir):
    return sequences.chunks(_seq(spark, sf_dir), 128)


def _dups(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("val"))
    return versions.numbered(rows, ("val",), "pos").select("pos", "val")


@query(SEQ + ", first AS (SELECT val, min(pos) AS pos FROM dup GROUP BY val) SELECT t, pos, val FROM (SELECT DISTINCT c_custkey * 3 AS t FROM customer) ASOF JOIN first ON t <= val")
def seq_dups(spark, sf_dir):
    return sequences.next_ge(_dups(spark, sf_dir), _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("t")))


@query(SEQ + "SELECT pos, val FROM dup")
def ef_roundtrip(spark, sf_dir):
    return sequences.unpack(sequences.pack(_dups(spark, sf_dir)))


@query(SEQ + "SELECT t, pos, val FROM targets ASOF JOIN seq ON t <= val")
def ef_next_ge(spark, sf_dir):
    """Successors from Elias-Fano blobs: the chunks' maxima lead to the one blob that is opened."""
    return sequences.packed_next_ge(sequences.pack(_seq(spark, sf_dir), 64), _targets(spark, sf_dir))


@query(SEQ + "SELECT pos, val FROM seq JOIN customer ON pos = c_custkey * 3")
def ef_get(spark, sf_dir):
    return sequences.packed_get(sequences.pack(_seq(spark, sf_dir), 64), _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("t")), 64)


@query(SEQ + """, c AS (SELECT count(*)::BIGINT AS n, (max(val) - min(val))::BIGINT AS top FROM seq GROUP BY pos // 3087),
w AS (SELECT n, top, floor(log2(greatest(top + 1, n) // n) + 1e-9)::INTEGER AS width FROM c)
SELECT sum(13 + (n * width + 7) // 8 + ((top >> width) + n + 7) // 8) * 8.0 / sum(n) AS bits_per_elem FROM w""")
def ef_bits_per_elem(spark, sf_dir):
    packed = sequences.pack(_seq(spark, sf_dir))
    return packed.agg((F.sum(F.octet_length("blob")) * 8 / F.sum("n")).alias("bits_per_elem"))


@query("SELECT doc_id, text AS decoded FROM documents")
def fsst_roundtrip(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    table = fsst.train_on(docs, "text", "doc_id")
    return fsst.decode(fsst.encode(docs, "text", table).select("doc_id", "coded"), "coded", table).select("doc_id", F.col("decoded").cast("string").alias("decoded"))


@query()
def fsst_ratio(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fsst.ratio(fsst.encode(docs, "text", fsst.train_on(docs, "text", "doc_id")), "text", "coded")


def _counts(df: DataFrame, column: str, pairs: bool) -> DataFrame:
    size = 65_536 if pairs else 256

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                x = np.frombuffer((t or "").encode(), np.uint8).astype(np.int64)
                total += np.bincount(x[:-1] * 256 + x[1:] if pairs else x, minlength=size)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["code", "n"])

    return df.select(column).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@query("SELECT ('0x' || x)::BIGINT AS byte, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY 1")
def byte_histogram(spark, sf_dir):
    return _counts(_table(spark, sf_dir, "documents"), "text", False).withColumnRenamed("code", "byte")


@query("WITH h AS (SELECT hex(encode(text)) AS h FROM documents), p AS (SELECT h[2 * i + 1 : 2 * i + 4] AS x FROM h, LATERAL (SELECT unnest(range(length(h) // 2 - 1)) AS i)) SELECT ('0x' || x)::BIGINT AS pair, least(count(*), 65535)::BIGINT AS n FROM p GROUP BY 1")
def bigram_counts(spark, sf_dir):
    return _counts(_table(spark, sf_dir, "documents"), "text", True).select(F.col("code").alias("pair"), F.least("n", F.lit(65_535)).alias("n"))


def _frames(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.expr("event_id div 500").alias("wal"), "event_id", frames.frame(F.col("event_id"), F.encode("props", "UTF-8")).alias("frame"))


def _files(spark, logs: DataFrame) -> DataFrame:
    """The logs, written as files and read again."""
    path = folder(spark)
    frames.write_files(logs, path)
    return frames.read_files(spark, path)


@query("SELECT event_id AS key, strlen(props)::BIGINT AS len FROM events")
def frame_scan(spark, sf_dir):
    return frames.scan(_files(spark, frames.append(_frames(spark, sf_dir), "wal", "event_id"))).where("status = 'ok'").select("key", "len")


@query("SELECT event_id AS key FROM events WHERE event_id % 17 <> 3 AND event_id % 29 <> 5")
def frame_resync(spark, sf_dir):
    """Some frames have a wrong CRC, some a wrong magic; the others survive."""
    f = F.col("frame")
    tenth = F.conv(F.hex(F.substring(f, F.lit(10), F.lit(1))), 16, 10).cast("int")
    crc = F.concat(F.substring(f, F.lit(1), F.lit(9)), F.unhex(F.hex(F.bitwise_not(tenth).bitwiseAND(255))), F.substring(f, F.lit(11), F.octet_length(f)))
    magic = F.concat(F.unhex(F.lit("00")), F.substring(f, F.lit(2), F.octet_length(f)))
    damaged = _frames(spark, sf_dir).withColumn("frame", F.when(F.col("event_id") % 17 == 3, crc).when(F.col("event_id") % 29 == 5, magic).otherwise(f))
    return frames.scan(_files(spark, frames.append(damaged, "wal", "event_id"))).where("status = 'ok'").select("key")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def payload_fetch(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 50").alias("wal_id"), F.encode("text", "UTF-8").alias("body"))
    before = Window.partitionBy("wal_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = docs.select("doc_id", "wal_id", F.octet_length("body").cast("long").alias("len")).withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)))
    payloads = _files(spark, frames.append(docs.select("wal_id", "doc_id", F.col("body").alias("frame")), "wal_id", "doc_id"))
    return frames.fetch(at, payloads).select("doc_id", F.md5("value").alias("md5"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 5000")
def seg_pruned_scan(spark, sf_dir):
    """Orders written as sorted segments of two levels; a range read opens only the files whose zone overlaps it."""
    path, orders = folder(spark), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    segments.write(orders.where("o_orderkey % 2 = 0"), path, "o_orderkey", 8, 3)
    segments.write(orders.where("o_orderkey % 2 = 1"), path, "o_orderkey", 8, 1)
    return segments.read(spark, path, "o_orderkey", 2000, 5000)


@query(LOG + "SELECT * FROM newest WHERE flag & 8 = 0")
def stream_ingest_latest(spark, sf_dir):
    path = folder(spark)
    schema = _table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.run(source, path, _shape)
    return versions.live(versions.latest(ingest.table(spark, path)))


@query("SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey DESC)::BIGINT AS rank FROM orders")
def kv_reverse_scan(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (-F.col("o_orderkey")).alias("back"))
    return versions.numbered(df, ("back",)).select("key", (F.col("n") + 1).alias("rank"))


@query("SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS rank FROM orders QUALIFY rank <= 10")
def kv_first_n(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).orderBy("key").limit(10)
    return df.withColumn("rank", F.row_number().over(Window.orderBy("key")).cast("long"))  # ten rows


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer")
def kv_exists(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    there = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct().withColumn("found", F.lit(True))
    return keys.join(there, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


@query(LOG + "SELECT key, ver FROM newest")
def log_compaction(spark, sf_dir):
    """A log rewritten to its newest rows in place of itself; what is read back afterwards."""
    path = folder(spark)
    segments.replace(_log(spark, sf_dir), path, "key", 4)
    segments.replace(versions.latest(segments.read(spark, path, "key")), path, "key", 4)
    return segments.read(spark, path, "key").select("key", "ver")


def _store(spark, sf_dir, batches: int) -> str:
    """A store of the log, flushed to level 0 in batches of versions; the folder."""
    path, log = folder(spark), _log(spark, sf_dir)
    most = (log.agg(F.max("ver")).first()[0] or 0) + 1
    for i in range(batches):
        part = log.where((F.col("ver") >= most * i // batches) & (F.col("ver") < most * (i + 1) // batches))
        segments.write(versions.latest(part), path, "key", 1, flag="flag")
    return path


@query(LOG + "SELECT * FROM newest WHERE flag & 8 = 0")
def compaction_apply(spark, sf_dir):
    """Six flushes, then compaction steps until none is due; what is live then, from the deepest level."""
    path = _store(spark, sf_dir, 6)
    while segments.compact_once(spark, path, "key", ("ver",), "flag", 4):
        pass
    segments.vacuum(spark, path)
    return segments.latest(spark, path, "key", ("ver",))


@query(LOG + "SELECT * FROM log WHERE ver < (SELECT max(ver) + 1 FROM log) * 2 // 4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ver DESC) = 1")
def manifest_snapshot(spark, sf_dir):
    """What the store's second version had, after two more flushes, a compaction and a vacuum that keeps that version."""
    path = _store(spark, sf_dir, 4)
    segments.compact_once(spark, path, "key", ("ver",), "flag", 2)
    segments.vacuum(spark, path, keep_from=2)
    return segments.latest(spark, path, "key", ("ver",), upto=2)


@query(LOG + "SELECT key, ver, flag, row_number() OVER (ORDER BY key DESC)::BIGINT AS rank FROM newest WHERE key >= 100 AND key < 1000")
def seg_reverse_range(spark, sf_dir):
    """A reverse range read over all segments, newest version of each key."""
    rows = segments.latest(spark, _store(spark, sf_dir, 3), "key", ("ver",), 100, 1000)
    return versions.numbered(rows.withColumn("back", -F.col("key")), ("back",)).select("key", "ver", "flag", (F.col("n") + 1).alias("rank"))


@query("""WITH s AS (SELECT o_orderkey // 7 AS seg, hex(encode(min(o_orderkey::VARCHAR))) AS min, hex(encode(max(o_orderkey::VARCHAR))) AS max FROM orders GROUP BY 1)
SELECT c_custkey AS rid, count(*)::BIGINT AS n FROM customer JOIN s ON max >= hex(encode(c_custkey::VARCHAR)) AND min < hex(encode(c_custkey::VARCHAR || 'z')) GROUP BY 1""")
def overlap_binary_keys(spark, sf_dir):
    """Ranges of binary keys (all that begin with a number) against many segments, which overlap each other."""
    orders = _table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 7").alias("seg"), F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("k"))
    k = F.col("c_custkey").cast("string")
    asked = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("rid"), F.encode(k, "UTF-8").alias("lo"), F.lit(True).alias("lo_inc"), F.encode(F.concat(k, F.lit("z")), "UTF-8").alias("hi"), F.lit(False).alias("hi_inc")
    )
    return ranges.overlap_cut(asked, ranges.zone_map(orders, "seg", "k")).groupBy("rid").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey // 100 AS seg, min(o_orderkey::VARCHAR) AS first, max(o_orderkey::VARCHAR) AS last, array_to_string(list_transform(list_filter(range(1, 20), lambda i: i <= least(length(min(o_orderkey::VARCHAR)), length(max(o_orderkey::VARCHAR))) AND min(o_orderkey::VARCHAR)[1:i] = max(o_orderkey::VARCHAR)[1:i]), lambda i: min(o_orderkey::VARCHAR)[i:i]), '') AS prefix FROM orders GROUP BY 1")
def key_prefix(spark, sf_dir):
    keys = _table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("seg"), F.col("o_orderkey").cast("string").alias("k"))
    ends = keys.groupBy("seg").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return ends.withColumn("prefix", bits.common_prefix(F.col("first"), F.col("last")))


@query("SELECT p_partkey AS word, p_size % 6 AS k, coalesce(list_filter(range(64), lambda i: (p_partkey >> i) & 1 = 1)[p_size % 6 + 1], 64)::INTEGER AS at, bit_count(p_partkey)::INTEGER AS ones FROM part")
def bit_select(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word"), (F.col("p_size") % 6).alias("k"))
    return part.withColumn("at", bits.select_bit(F.col("word"), F.col("k")).cast("int")).withColumn("ones", F.bit_count("word").cast("int"))


@query("SELECT * FROM (VALUES (0, 'UNCOMPRESSED'), (1, 'LZ4_RAW'), (2, 'LZ4_RAW'), (3, 'ZSTD'), (4, 'ZSTD'), (5, 'ZSTD'), (6, 'ZSTD')) v(level, codec), (SELECT count(*)::BIGINT AS n FROM orders) c")
def level_codecs(spark, sf_dir):
    """Orders written as segments of each level: the codec that the files' own footers name, and their rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    orders, out = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), []
    for level in levels.CODECS:
        path = folder(spark)
        segments.write(orders, path, "o_orderkey", 2, level)
        found, n = set(), 0
        for r in segments.manifest(spark, path).select("file").collect():  # two files
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(r["file"]), conf))
            for block in reader.getFooter().getBlocks():
                found.add(block.getColumns()[0].getCodec().name())
                n += block.getRowCount()
            reader.close()
        out.append((level, ",".join(sorted(found)), n))
    return spark.createDataFrame(out, "level int, codec string, n long")


@query("""WITH h AS (SELECT ('0x' || x)::BIGINT AS byte, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY 1)
SELECT arg_min(b, (coalesce(n, 0), b))::INTEGER AS terminator FROM range(256) r(b) LEFT JOIN h ON b = byte""")
def byte_terminator(spark, sf_dir):
    """The least frequent byte, the first of equal ones."""
    counts = _counts(_table(spark, sf_dir, "documents"), "text", False).withColumnRenamed("code", "b")
    every = spark.range(256).select(F.col("id").alias("b"))
    return every.join(F.broadcast(counts), "b", "left").agg(F.min_by("b", F.struct(F.coalesce("n", F.lit(0)), "b")).cast("int").alias("terminator"))


@query()
def fsst_dictionary(spark, sf_dir):
    table = fsst.train_on(_table(spark, sf_dir, "documents"), "text", "doc_id")
    return spark.createDataFrame(fsst.dictionary(table), "code int, length int, symbol binary")

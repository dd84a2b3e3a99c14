import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import elias_fano, fsst
from strata.functions.bounds import Range, is_before, overlaps
from strata.operators import levels, ranges, sequences, versions
from strata.plans import queries as store
from strata.sources import frames, segments
from strata.streaming import ingest

MIB = 1024 * 1024


@pytest.mark.parametrize("name", sorted(store.SQL))
def test_query_matches_sql(same, name):
    same(store.QUERIES[name], store.SQL[name])


@pytest.mark.parametrize("name", sorted(set(store.QUERIES) - set(store.SQL)))
def test_query_runs(spark, name):
    assert store.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_layers_shadow_without_discards(spark):
    rows = [("key1", 1, 1, 0), ("key1", 2, 0, 0), ("key1", 3, 0, 0), ("key1", 4, 0, 8)]
    log = spark.createDataFrame(rows, "key string, ver long, layer int, flag int")
    assert sorted(r.ver for r in versions.discards(log).collect()) == [2, 3]  # what a newer layer shadows is no discard
    newest = versions.latest(log, layer="layer").collect()
    assert [(r.key, r.ver) for r in newest] == [("key1", 4)]
    assert versions.live(versions.latest(log, layer="layer")).count() == 0
    assert log.where("layer = 0").agg(F.sum(versions.entry_bytes(F.col("key")))).first()[0] == 204


def test_overlap_agrees_with_before_and_after(spark):
    ends = [None, 1, 3, 5]
    rows = [(a, ai, b, bi) for a in ends for ai in (True, False) for b in ends for bi in (True, False)]
    df = spark.createDataFrame([(*x, *y) for x in rows for y in random.Random(1).sample(rows, 12)], "alo int, alo_inc boolean, ahi int, ahi_inc boolean, blo int, blo_inc boolean, bhi int, bhi_inc boolean")
    a, b = Range.of("a"), Range.of("b")
    assert df.where(overlaps(a, b) == (is_before(a, b) | is_before(b, a))).count() == 0


def test_bucketed_overlap_is_nested_loop(spark):
    r = random.Random(2)
    asked = [(i, lo := r.choice([None, r.randrange(300)]), r.random() < 0.5, None if r.random() < 0.2 else (lo or 0) + r.randrange(40), r.random() < 0.5) for i in range(60)]
    q = spark.createDataFrame(asked, "rid int, lo long, lo_inc boolean, hi long, hi_inc boolean")
    s = spark.createDataFrame([(i, x := r.randrange(300), x + r.randrange(50)) for i in range(40)], "seg int, min long, max long")
    pairs = lambda df: sorted((x.rid, x.seg) for x in df.collect())
    assert pairs(ranges.overlap_bucketed(q, s, 16)) == pairs(ranges.overlap(q, s))


def _score(spark, level, files, actual, target):
    df = spark.createDataFrame([(level, files, actual, target)], "level int, files long, actual long, target long")
    return df.select(levels.level_score(*map(F.col, ("level", "files", "actual", "target")))).first()[0]


def test_level_goldens(spark):
    got = [_score(spark, 0, n, 0, 0) for n in range(11)]
    assert got == [0, 32, 64, 96, 128, 160, 192, 224, 256, 4294967295, 4294967295]
    assert _score(spark, 3, 1, 5, 0) == 4294967295 and _score(spark, 3, 0, 0, 0) == 0 and _score(spark, 3, 1, 300, 200) == 192

    def targets(total):
        df = spark.createDataFrame([(total,)], "total long")
        return {r.level: r.target for r in levels.level_targets(df).collect() if r.target}

    assert targets(2048 * MIB - 1) == {6: 2048 * MIB - 1}
    assert targets(2048 * MIB) == {5: 256 * MIB, 6: 2048 * MIB}
    assert targets(10240 * MIB) == {5: 1342177280, 6: 10737418240}
    for total, base in ((16 << 30, 4), (128 << 30, 3), (1 << 40, 2), (8 << 40, 1), (64 << 40, 1)):
        assert min(targets(total)) == base


def test_pick(spark):
    kind = "id long, level int, size long, rmed long"
    pick = lambda rows: [tuple(r) for r in levels.compaction_pick(spark.createDataFrame(rows, kind)).collect()]
    assert pick([(i, 0, 1, 0) for i in range(3)]) == []
    assert pick([(i, 0, 1, 0) for i in range(4)]) == [(0, 6, None)]
    assert pick([(1, 5, 10, 4), (2, 5, 10, 4)]) == [(5, 6, 2)]  # the latest of equal files


def test_replay_takes_the_last_action(spark):
    df = spark.createDataFrame([(1, 1, True, 0), (1, 2, True, 1), (1, 2, False, 0), (2, 1, True, 0), (2, 3, False, 0)], "id int, seq int, add boolean, level int")
    assert [(r.id, r.level) for r in levels.replay(df).collect()] == [(1, 1)]


def test_elias_fano():
    r = np.random.default_rng(42)
    for v in ([], [42], [10, 10, 10, 20, 20], [0, 10**12], [2**64 - 11, 2**64 - 1], np.cumsum(r.integers(0, 96, 6000)), [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]):
        v = np.array(v, np.uint64)
        assert (elias_fano.decode(elias_fano.encode(v)) == v).all()
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))
    v = np.cumsum(r.integers(32, 96, 50_000))
    assert sum(len(elias_fano.encode(v[i : i + 3087])) for i in range(0, len(v), 3087)) * 8 / len(v) < 9


def test_sequence_search(spark):
    v = [2, 3, 5, 7, 7, 11, 13, 17, 19, 23, 29, 500, 501]
    seq = spark.createDataFrame(list(enumerate(v)), "pos long, val long")
    asked = spark.createDataFrame([(t,) for t in (0, 6, 7, 8, 12, 30, 502)], "t long")
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.t: (r.pos, r.val) for r in sequences.next_ge(seq, asked).collect()}
        assert got == {t: next((i, x) for i, x in enumerate(v) if x >= t) for t in (0, 6, 7, 8, 12, 30)}
        got = {r.t: (r.pos, r.val) for r in sequences.prev_lt(seq, asked).collect()}
        assert got == {t: [(i, x) for i, x in enumerate(v) if x < t][-1] for t in (6, 7, 8, 12, 30, 502)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fsst():
    texts = [b"", b"\xff\xff", b"a\xffb", bytes(range(256)), "naïve 数据 the the theory".encode(), b"the cat sat on the mat " * 20]
    table = fsst.train(texts)
    for t in texts:
        assert table.decode(table.encode(t)) == t
    assert len(table.encode(texts[-1])) < len(texts[-1]) // 2
    with pytest.raises(ValueError):
        fsst.train([b"", b""])


def test_frames(spark):
    df = spark.createDataFrame([(1, i, bytearray(b"\xab" * (i % 4))) for i in range(6)], "wal int, key long, body binary")
    good = bytes(frames.append(df.select("wal", "key", frames.frame(F.col("key"), F.col("body")).alias("frame")), "wal", "key").first()["data"])
    ok = lambda d: [k for _, k, _, s in frames.parse(d) if s == "ok"]
    assert ok(good) == [0, 1, 2, 3, 4, 5]
    assert ok(good[:-1])[-1] == 4 and frames.parse(good[:-1])[-1][3] == "need_more"
    assert ok(b"\x00" + good[1:]) == [1, 2, 3, 4, 5]
    assert ok(good[:10] + bytes([good[10] ^ 1]) + good[11:]) == [1, 2, 3, 4, 5]
    assert ok(b"") == [] and ok(b"garbage of no frame") == []


def test_segments(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.range(1000).withColumnRenamed("id", "key")
    assert segments.version(spark, path) == 0 and segments.write(df, path, "key", 4, 6) == 1
    got = segments.read(spark, path, "key", 100, 200, hi_inc=True)
    assert sorted(r.key for r in got.collect()) == list(range(100, 201)) and len(got.inputFiles()) < 4
    assert segments.read(spark, path, "key", 5000).count() == 0
    df.write.parquet(f"{path}/data/lost")
    assert segments.vacuum(spark, path) == 0  # it may be about to be committed
    assert segments.vacuum(spark, path, grace=0) == 1 and segments.read(spark, path, "key").count() == 1000


def test_versions_of_a_store(spark, tmp_path):
    """Readers keep what their version has until it is vacuumed; what is staged is not seen; a repeated commit is one."""
    path = f"file://{tmp_path}/s"
    rows = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "key")
    segments.write(rows(0, 10), path, "key", 1, generation="a")
    held = segments.read(spark, path, "key")
    assert segments.replace(rows(5, 8), path, "key") == 2
    name, ops = segments.stage(rows(100, 110), path, "key", 1)
    assert segments.read(spark, path, "key").count() == 3 and held.count() == 10 and segments.read(spark, path, "key", upto=1).count() == 10
    assert segments.vacuum(spark, path, keep_from=1) == 0 and held.count() == 10
    assert segments.commit(spark, path, name, ops) == segments.commit(spark, path, name, ops) == 3
    assert segments.write(rows(0, 10), path, "key", 1, generation="a") == 1 and segments.read(spark, path, "key").count() == 13
    assert segments.vacuum(spark, path, grace=0) == 1 and segments.read(spark, path, "key").count() == 13


def test_checkpoints(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert segments.checkpoint(spark, path) == 0 and segments.manifest(spark, path) is None
    rows = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "key")
    for i in range(3):
        segments.write(rows(10 * i, 10 * i + 10), path, "key", 1)
    before = sorted(map(str, segments.manifest(spark, path).select("file", "version", "n").collect()))
    assert segments.checkpoint(spark, path) == segments.checkpoint(spark, path) == 3
    assert sorted(map(str, segments.manifest(spark, path).select("file", "version", "n").collect())) == before
    segments.replace(rows(0, 4), path, "key")
    assert segments.read(spark, path, "key").count() == 4 and segments.read(spark, path, "key", upto=3).count() == 30 and segments.read(spark, path, "key", upto=2).count() == 20
    assert segments.operations(spark, path, after=3).count() == 4


def test_compaction_loop(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in range(5):
        df = spark.range(100).selectExpr("encode(lpad(id, 3, '0'), 'utf-8') as key", f"cast({i} as long) as ver", f"cast(if(id % 10 = {i}, 8, 0) as int) as flag")
        segments.write(df, path, "key", 2, flag="flag")
    newest = segments.latest(spark, path, "key", ("ver",))
    assert newest.count() == 100 and newest.where("flag = 8").count() == 10
    assert segments.compact_once(spark, path, "key", ("ver",), "flag", 2) == (0, 6)
    assert segments.compact_once(spark, path, "key", ("ver",), "flag", 2) is None
    live = segments.manifest(spark, path)
    assert live.agg(F.sum("n"), F.min("level"), F.max("end_offset") > 0).first()[:] == (90, 6, True)
    assert segments.latest(spark, path, "key", ("ver",), b"010", b"020").count() == 9
    assert segments.vacuum(spark, path, grace=0) == 5 and segments.read(spark, path, "key").count() == 90


def test_settings(spark, tmp_path):
    import pyarrow.parquet as pq

    own = segments.Settings.of(4, {"strength": 7}, {"strength": 2, "dictionary": False}, {"row_group": 1024, "parquet.page.size": 512})
    assert (own.codec, own.strength, own.dictionary, own.row_group, own.more) == ("zstd", 2, False, 1024, {"parquet.page.size": 512})
    for level, codec in ((0, "UNCOMPRESSED"), (1, "LZ4_RAW"), (6, "ZSTD")):
        path = tmp_path / str(level)
        segments.write(spark.range(50_000).selectExpr("id as key", "id % 7 as x"), f"file://{path}", "key", 1, level, settings=segments.Settings.of(level, {"row_group": 100_000}))
        meta = pq.ParquetFile(next(path.glob("data/*/part-*"))).metadata
        assert meta.row_group(0).column(0).compression in (codec, codec.removesuffix("_RAW")) and meta.num_row_groups > 1


def test_a_retried_batch_is_there_once(spark, tmp_path):
    src, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(10).selectExpr("id as key").write.parquet(src)
    stream = lambda: spark.readStream.schema("key long").parquet(src)
    ingest.run(stream(), path, lambda df: df)
    shutil.rmtree(tmp_path / "out" / "progress")  # as if the batch's end had not been noted
    ingest.run(stream(), path, lambda df: df)
    spark.range(10, 15).selectExpr("id as key").write.mode("append").parquet(src)
    ingest.run(stream(), path, lambda df: df)
    assert ingest.table(spark, path).count() == 15 and ingest.table(spark, path, upto=1).count() == 10


def test_versions_of_odd_rows(spark):
    kind = "key string, ver long, layer int, flag int, newest string"
    df = spark.createDataFrame([(None, 1, 0, 0, "a"), (None, 2, 0, 0, "b"), ("k", 5, 0, 0, "c"), ("k", 5, 0, 0, "c"), ("k", None, 0, 8, None)], kind)
    assert sorted((r.key or "", r.ver) for r in versions.latest(df).collect()) == [("", 2), ("k", 5)]
    assert sorted((r.key or "", r.ver or 0) for r in versions.discards(df).collect()) == [("", 1), ("", 2), ("k", 0)]
    keys = spark.createDataFrame([(None,), ("k",), ("z",)], "key string")
    assert [r.key for r in versions.multi_get(versions.latest(df), keys).collect()] == ["k"]
    assert sorted(r.key or "" for r in versions.missing(versions.latest(df), keys).collect()) == ["", "z"]
    for f in (versions.latest, versions.discards, versions.merge):
        assert f(df.limit(0)).count() == 0


def test_rotation_by_bytes(spark):
    """A segment of keys that count 68 bytes each, closed once 70 are reached, holds two; one entry may be over."""
    log = spark.createDataFrame([(1, i, "key1") for i in range(5)] + [(2, 7, "k" * 500), (2, 9, "k")], "w long, ver long, key string")
    got = versions.rotated(log, "w", ("ver",), versions.entry_bytes(F.col("key")), 70).orderBy("w", "segment").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2, 136, 0, 1), (1, 1, 2, 136, 2, 3), (1, 2, 1, 68, 4, 4), (2, 0, 1, 564, 7, 7), (2, 1, 1, 65, 9, 9)]


def test_positions_and_running_folds(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(1000), r.choice([None, r.randrange(50)])) for i in r.sample(range(10**6), 300)]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], "id long, n long, v long, file string, at string")
    ordered = sorted(rows)
    got = {x.id: x.n for x in versions.numbered(df, ("id",)).collect()}
    assert got == {x[0]: i for i, x in enumerate(ordered)}
    for f, into, of, start in ((versions.running, "s", lambda a, b: a + (b or 0), 0), (versions.running_max, "n", lambda a, b: max(a, -(2**63) if b is None else b), -(2**63))):
        got, last = {x.id: x[into] for x in f(df, ("id",), F.col("v"), into).collect()}, start
        for i, _, v in ordered:
            last = of(last, v)
            assert got[i] == last
    assert {x.id: x.n for x in versions.running(df, ("id",), F.col("v"), "s", "n").collect()} == {x[0]: i for i, x in enumerate(ordered)}
    empty = df.limit(0)
    assert versions.numbered(empty, ("id",)).count() == versions.running(empty, ("id",), F.col("v"), "s").count() == 0


def test_overlap_by_cuts_for_any_keys(spark):
    r = random.Random(4)
    key = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    segs = [(i, *sorted((key(), key()))) for i in range(60)]
    asked = [(i, r.choice([None, key()]), r.random() < 0.5, r.choice([None, key()]), r.random() < 0.5) for i in range(60)]
    s = spark.createDataFrame(segs, "seg int, min string, max string")
    q = spark.createDataFrame(asked, "rid int, lo string, lo_inc boolean, hi string, hi_inc boolean")
    pairs = lambda df: sorted((x.rid, x.seg) for x in df.collect())
    want = pairs(ranges.overlap(q, s))
    sane = {i for i, lo, _, hi, _ in asked if lo is None or hi is None or lo <= hi}
    assert [p for p in pairs(ranges.overlap(q, s, 3, 8)) if p[0] in sane] == [p for p in want if p[0] in sane]
    raw = lambda df, *names: df.withColumns({n: F.encode(n, "utf-8") for n in names})
    assert [p for p in pairs(ranges.overlap_cut(raw(q, "lo", "hi"), raw(s, "min", "max"), 5)) if p[0] in sane] == [p for p in want if p[0] in sane]
    assert ranges.overlap_cut(q, s.limit(0)).count() == 0


def test_disjoint_violations(spark):
    rows = [(i, 10 * i, 10 * i + (25 if i in (3, 17) else 5)) for i in range(30)]
    got = ranges.disjoint_violations(spark.createDataFrame(rows, "seg int, min long, max long")).collect()
    assert {r.seg for r in got} == {4, 18}


def test_search_on_blobs(spark):
    v = [2, 3, 5, 7, 7, 11, 13, 17, 19, 23, 29, 500, 501]
    packed = sequences.pack(spark.createDataFrame(list(enumerate(v)), "pos long, val long"), 4)
    asked = spark.createDataFrame([(t,) for t in (0, 6, 7, 8, 12, 30, 502)], "t long")
    got = {r.t: (r.pos, r.val) for r in sequences.packed_next_ge(packed, asked).collect()}
    assert got == {t: next((i, x) for i, x in enumerate(v) if x >= t) for t in (0, 6, 7, 8, 12, 30)}
    assert {r.pos: r.val for r in sequences.packed_get(packed, asked, 4).collect()} == {0: 2, 6: 13, 7: 17, 8: 19, 12: 501}


def test_log_files_and_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "PIECE", 7)
    data = {1: bytes(range(256)), 2: b"\xff\xab\n" * 9, 3: b"x"}
    logs = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "log long, data binary")
    frames.write_files(logs, f"file://{tmp_path}/logs")
    read = frames.read_files(spark, f"file://{tmp_path}/logs")
    assert {r.log: bytes(r.data) for r in read.collect()} == {k: v + b"\n" for k, v in data.items()}
    asked = [(1, 0, 256), (1, 13, 1), (1, 6, 2), (1, 250, 7), (2, 5, 20), (2, 5, 20), (3, 0, 0), (3, 9, 1), (4, 0, 1), (1, 7, 7)]
    got = frames.fetch(spark.createDataFrame(asked, "wal_id long, offset long, len long"), logs).collect()
    want = [(*a, data[a[0]][a[1] : a[1] + a[2]] if a[0] in data and a[1] + a[2] <= len(data[a[0]]) else None) for a in asked]
    key = lambda x: (x[:3], x[3] or b"")
    assert sorted([(r.wal_id, r.offset, r.len, None if r.value is None else bytes(r.value)) for r in got], key=key) == sorted(want, key=key)


def test_positions_that_no_log_has(spark, monkeypatch):
    monkeypatch.setattr(frames, "PIECE", 7)
    logs = spark.createDataFrame([(1, bytearray(b"0123456789")), (2, bytearray())], "log long, data binary")
    asked = [(1, 2, 3), (1, 5, 5), (1, 10, 0), (2, 0, 0), (1, 12, 0), (1, 11, 0), (1, -1, 3), (1, 3, -1), (1, 5, 6), (2, 0, 1), (1, 2**62, 2**62), (1, 0, 2**62), (1, None, 1), (1, 0, None), (None, 0, 1)]
    want = dict.fromkeys(asked) | {(1, 2, 3): b"234", (1, 5, 5): b"56789", (1, 10, 0): b"", (2, 0, 0): b""}
    got = frames.fetch(spark.createDataFrame(asked, "wal_id long, offset long, len long"), logs).collect()
    assert len(got) == len(asked) and {r[:3]: None if r.value is None else bytes(r.value) for r in got} == want


def test_positions_keep_no_copies_of_a_log(spark):
    """Positions of a log of 3 MB, in one piece or in two, whose pieces for each would not fit in memory: no task spills."""
    data = random.Random(1).randbytes(3000) * (frames.PIECE // 1000)
    logs = spark.createDataFrame([(1, bytearray(data))], "log long, data binary")
    asked = [(1, i * 100, 50) for i in range(5000)] + [(1, 2 * frames.PIECE - 1 - i, 600) for i in range(500)]
    sc, group = spark.sparkContext, "positions"
    sc.setJobGroup(group, group)
    try:
        got = frames.fetch(spark.createDataFrame(asked, "wal_id long, offset long, len long").coalesce(1), logs).collect()
    finally:
        sc.setJobGroup("others", "others")
    assert sorted(r[:3] for r in got) == sorted(asked) and all(r.value == data[r.offset : r.offset + r.len] for r in got)
    tracker, most = sc.statusTracker(), sc._gateway.new_array(sc._jvm.double, 1)
    most[0] = 1.0
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
    tasks = [x.get() for x in (sc._jsc.sc().statusStore().taskSummary(k, 0, most) for k in stages) if x.isDefined()]
    assert tasks and [x.memoryBytesSpilled().apply(0) for x in tasks] == [0] * len(tasks)


def test_tables_of_symbols():
    r = random.Random(1)
    assert fsst.hash_of(0) == 0 and fsst.hash_of(1) == 2971215073 ^ (2971215073 >> 15)
    for _ in range(100):
        values = [bytes(r.choices([255, 254, 97, 98, 0], k=r.randrange(0, 40))) for _ in range(r.randrange(1, 8))]
        try:
            table = fsst.train(values)
        except ValueError:
            continue
        sizes = [len(s) for s in table.symbols]
        long, heads = [n for n in sizes if n > 2], {s[:2] for s in table.symbols if len(s) > 2}
        twos = [s in heads for s in table.symbols if len(s) == 2]
        assert sizes == [2] * len(twos) + sorted(long) + [1] * sizes.count(1) and twos == sorted(twos, reverse=True)
        coded = table.encode_all(values)
        assert table.decode_all(coded) == values and [table.encode(v) for v in values] == coded and [table.decode(c) for c in coded] == values
        assert all(len(c) <= 2 * len(v) for c, v in zip(coded, values))
    with pytest.raises(ValueError):
        fsst.train([b""])


def test_fsst_sample_is_whole_values_up_to_its_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fsst, "train", seen.append)
    keys = spark.range(5000).selectExpr("id", "lpad(id, 8, 'k') as v", "repeat('x', 40000) as t")
    fsst.train_on(keys, "v", "id")
    fsst.train_on(keys, "t", "id")
    fsst.train_on(keys.limit(3), "v", "id")
    assert [(len(v), sum(map(len, v))) for v in seen] == [(2048, 16384), (1, 40000), (3, 24)]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from strata import scratch

    set_to = {}
    conf = SimpleNamespace(get=lambda k, d: set_to.get(k, d), set=set_to.__setitem__)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:///")
    set_to["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs://x/y"

import random
from itertools import combinations

from strata.llm import graph, jaccard, queries


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    s = {i: sets(t) for i, t in docs}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def fixture():
    r = random.Random(5)
    word = lambda: r.choice(["ab", "cd", "ef"]) + str(r.randrange(400))
    docs, n = [], 0
    shared = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([4, 6, 25, 120, 300]))]
        for _ in range(r.choice([1, 2, 12])):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 20)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w += shared
            docs.append((n, (" " if r.random() < 0.5 else "\n\t").join(w)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "A b"), (n + 4, "a  B"), (n + 5, "a b c d e"), (n + 6, "x " * 3000), (n + 7, "X " * 9)]
    for k in range(60):  # a chain of texts, each like the next only
        docs.append((n + 10 + k, " ".join(f"c{i}" for i in range(k * 10, k * 10 + 90))))
    return docs


def check(got, want):
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *x) for i, x in want.items()}


def test_against_all_pairs(frame):
    docs = fixture()
    got = jaccard.join(frame([(i, t, i) for i, t in docs], "doc_id long, text string, sid long")).collect()
    assert len(got) == len(docs)
    check(got, brute(docs))


def test_small_blocks_lose_nothing(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    docs = fixture()
    check(jaccard.join(frame(docs, "doc_id long, text string")).collect(), brute(docs))


def test_query_against_all_pairs(spark):
    p = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{p}/documents.parquet").collect()]
    check(queries.op8_jaccard_join(spark, p).collect(), brute(docs))


def test_bitmaps_bound_the_overlap():
    import numpy as np

    r = np.random.default_rng(1)
    for na, nb in ((5, 700), (300, 310), (64, 64)):
        a = np.unique(r.integers(0, 2**63, na).astype(np.uint64))
        b = np.unique(np.concatenate([a[: na // 2], r.integers(0, 2**63, nb).astype(np.uint64)]))
        bound = jaccard.overlap_bound(len(a), jaccard.bitmap(a), len(b), jaccard.bitmap(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_one_of_each_group_stays(frame):
    docs = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (7, "other words are in here too", None), (None, "a b c d e f", "z"), (9, None, "w")]
    got = jaccard.keep_first(frame(docs, "doc_id long, text string, n string"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id or -1, r.n or "") for r in got.collect()) == [(-1, "z"), (1, "y"), (7, ""), (9, "w")]


def test_texts_of_one_id_are_decided_apart(frame):
    copied, other, third = "a b c d e f", "other words are in here too", "and some third text that is like none"
    docs = [(1, copied, "a"), (5, copied, "b"), (5, other, "c"), (5, other, "c"), (8, other, "d"), (8, third, "e"), (8, None, "f"), (None, copied, "g")]
    got = jaccard.keep_first(frame(docs, "doc_id long, text string, row string"))
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(r.row for r in got.collect()) == ["a", "c", "e", "f", "g"]


def test_common_shingles_make_several_stars(frame, monkeypatch):
    """Very small limits: many shingles are common, and each of them is cut into parts."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "HEAVY", 10**9)
    monkeypatch.setattr(jaccard, "LOCALLY_COMMON", 2)
    docs = fixture()
    check(jaccard.join(frame(docs, "doc_id long, text string")).collect(), brute(docs))


def test_hubs_are_spread_and_components_right(spark, monkeypatch):
    """A hub with a third of all edges, on either side, and a component with most nodes: no key and salt has many rows."""
    monkeypatch.setattr(graph, "LEAST", 50)
    edges = [(0, i) for i in range(1, 3_000)] + [(i, 9_999_999) for i in range(10_000, 11_500)] + [(i, i + 1) for i in range(20_000, 20_100)] + [(5, 5), (None, 4)]
    edges += [(100_000 + 2 * i, 100_001 + 2 * i) for i in range(3_000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got[2_999] == 0 and got[9_999_999] == got[11_499] == 10_000 and got[20_100] == 20_000 and got[100_001] == 100_000 and len(got) == 3_000 + 1_501 + 101 + 6_000
    both = df.where("a <> b").selectExpr("a node", "b `to`").union(df.where("a <> b").selectExpr("b", "a"))
    hubs = graph.heavy_keys(both, "to")
    assert set(hubs) == {0, 9_999_999}
    dealt = graph.spread(both, "to", hubs, "node").groupBy("to", "salt").count()
    assert dealt.agg({"count": "max"}).first()[0] < 0.01 * both.count()
    assert graph.components(df.limit(0)).count() == 0


def test_an_id_with_several_texts(frame):
    docs = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (2, "one two three four five six"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"), (3, "one two three four five six")]
    got = sorted({(r.doc_id, r.component_id) for r in jaccard.join(frame(docs, "doc_id long, text string")).collect()})
    assert got[0] == (1, 1) and {c for i, c in got if i == 3} <= {1, 2}


def test_very_long_text(frame):
    body = " ".join(f"w{i % 70_001}" for i in range(200_000))
    docs = [(1, body), (2, body + " more"), (3, "short"), (4, "w" * 1_000_000)]
    got = {r.doc_id: r for r in jaccard.join(frame(docs, "doc_id long, text string")).collect()}
    assert got[2].component_id == 1 and got[3].component_id == 3 and got[4].n_shingles == 1


def test_empty_table(frame):
    assert jaccard.join(frame([], "doc_id long, text string")).count() == 0

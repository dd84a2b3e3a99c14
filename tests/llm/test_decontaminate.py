import hashlib
import random

from strata.llm import decontaminate as d
from strata.llm import queries


def brute(text, items, window=13):
    w, hit, found = d.words_of(text), set(), set()
    for item, body in items:
        x = d.words_of(body)
        n = min(window, len(x))
        for s in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == s:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


def test_random_words_against_brute_force(frame):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [(i, text(r.choice([1, 5, 12, 13, 14, 30]) if i else 9)) for i in range(12)] + [(12, None), (13, ""), (3, text(20)), (None, text(20))]
    docs = [(i, text(r.randrange(60))) for i in range(60)] + [(60, None), (61, ""), (62, "A-b'A \u00c9 x"), (5, text(40))]
    for block in (d.BLOCK_WORDS, 40, 13):
        got = d.digest(d.find_spans(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), block_words=block)).collect()
        want = sorted((i, *brute(t, [x for x in items if x[0] is not None])) for i, t in docs)
        assert sorted(tuple(x) for x in got) == want


def test_query_against_brute_force(spark):
    p = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{p}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_decontamination(spark, p).collect()}
    some = 0
    for r in spark.read.parquet(f"{p}/documents.parquet").collect():
        want = brute(r.text, items)
        some += want[1] > 0
        assert got[r.doc_id] == want
    assert some


def test_spans_go_and_the_rest_stays(frame):
    item = " ".join(f"w{i}" for i in range(15))
    clean = "Quite another, wholly clean text. " * 20
    docs = frame([(1, clean + "\nHERE: " + item.upper() + ", end é", 9, "x"), (2, item, 9, "x"), (3, clean, 9, "x"), (4, None, None, "x"), (5, "", 0, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in d.remove_spans(docs, frame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3].text == clean and got[4].text is None and got[3].spans == "x"
    assert got[1].text == clean + "\nHERE: , end é" and got[1].n_chars == len(got[1].text)


def test_blocks_are_judged_and_cut_together(frame):
    def words(c, n):
        return [f"{c}{i}" for i in range(n)]

    p, q, x = words("p", 15), words("q", 15), words("x", 20)
    share = " ".join(p + words("s", 20) + q)  # 30 % of hits by each item
    overlap = " ".join(["start"] + x + words("e", 60))  # windows x0..x12 and x7..x19 are of two items
    joined = " ".join(words("j", 40)[:7] + p + words("j", 40)[7:] + words("k", 40))  # the cut puts j0..j12 together
    items = [(1, " ".join(p)), (2, " ".join(q)), (3, " ".join(x[:13])), (4, " ".join(x[7:])), (5, " ".join(words("j", 13)))]
    docs = frame([(1, share), (2, overlap), (3, joined), (4, None)], "doc_id long, text string")
    want = {2: " ".join(["start", "", *words("e", 60)]), 3: " ".join([*words("j", 7), "", *words("j", 40)[7:], *words("k", 40)]), 4: None}
    for block in (d.BLOCK_WORDS, 1):
        assert dict(map(tuple, d.remove_spans(docs, frame(items, "item_id long, text string"), block_words=block).collect())) == want


def test_pieces_hold_each_window():
    words = [str(i).encode() for i in range(100)]
    for most in (1, 13, 14, 40, 99, 100):
        cut = d.pieces(words, 13, most)
        assert all(13 <= len(p) <= max(13, most) for p in cut)
        assert {tuple(p[i : i + 13]) for p in cut for i in range(len(p) - 12)} == {tuple(words[i : i + 13]) for i in range(88)}
    assert d.pieces([], 13, 5) == [] and d.pieces(words[:4], 13, 2) == [words[:4]]


def test_very_long_texts(frame):
    item = " ".join(f"q{i}" for i in range(500))
    body = " ".join(f"w{i}" for i in range(200_000))
    docs = frame([(1, f"{body} {item} {body}"), (2, "x" * 1_000_000), (3, item)], "doc_id long, text string")
    got = {r.doc_id: r for r in d.digest(d.find_spans(docs, frame([(7, item)], "item_id long, text string"), block_words=100)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (400_500, 500, False) and got[2].n_words == 1 and got[3].contaminated
    assert {r.doc_id: len(r.text) for r in d.remove_spans(docs, frame([(7, item)], "item_id long, text string"), block_words=100).collect()} == {1: 2 * len(body) + 2, 2: 1_000_000}


def test_empty_tables(frame):
    docs, items = frame([], "doc_id long, text string"), frame([], "item_id long, text string")
    assert d.find_spans(docs, items).count() == 0
    assert [tuple(r)[1:4] for r in d.digest(d.find_spans(frame([(1, "a b")], "doc_id long, text string"), items)).collect()] == [(2, 0, 0)]

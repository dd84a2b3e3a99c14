import html
import re

import numpy as np

from strata.llm import chat, queries, site_style, topk, url_filter

P = "/root/testdata/sf0.001"


def test_queries_match_sql(same):
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name], sql)


def test_aliases_share_decisions(frame):
    rows = [
        (1, "http://a.foo.org/x", '<link rel="canonical" href="http://b.com/en/1">'), (2, "http://b.com/en/1", ""),
        (3, "http://c.foo/x?q=1", '<meta http-equiv="refresh" content="0; url=/y">'), (4, "http://c.foo/y#z", "<link href=//d.foo/z rel=canonical>"),
        (5, "http://d.foo/z", "<link rel=canonical href=http://sub.net/de/1>"), (6, "http://www.example.com/en/7x", '<link rel=canonical href="http://e.foo/">'),
        (7, "http://e.foo/", '<link rel=canonical href="http://f.com/en/">'), (8, None, None), (9, "nope", "<link rel=canonical href=http://f.com/en/>"),
        (10, "HTTP://EXAMPLE.net/de/8?x", ""), (1, "http://a.foo.org/x", None), (11, "http://g.foo/", "<!-- <link rel=canonical href=http://b.com/en/1> -->"),
    ]
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in url_filter.judge(frame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect())
    assert got == [
        (1, "", "block"), (1, "", "block"), (2, "com/en/", "block"), (3, "", "block"), (4, "", "block"), (5, "", "block"), (6, "example.com/en/7", "allow"),
        (7, "", "allow"), (8, "", "allow"), (9, "", "allow"), (10, "example.net/de/8", "block"), (11, "", "allow"),
    ]
    assert url_filter.judge(frame([], "page_id long, url string, html string")).count() == 0


def test_long_redirect_chain(frame):
    rows = [(i, f"http://h.foo/{i}", f"<link rel=canonical href=/{i + 1}>") for i in range(40)] + [(99, "http://h.foo/40", "<link rel=canonical href=http://x.org/es/>")]
    assert url_filter.judge(frame(rows, "page_id long, url string, html string")).where("verdict = 'block'").count() == 41


def test_articles(spark):
    got = {r.page_id: r for r in queries.op10_site_style_tree(spark, P).collect()}
    for r in spark.read.parquet(f"{P}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_repeated_branches_go_by_entropy(frame):
    page = '<body><div class="x1">Same words on all pages</div><div class="x2"><p>Text {0} &amp; more<br>  of\nit</p><ul><li>{0}</li></ul></div><div class="x3"><p>{1}</p></div></body>'
    rows = [(i, "http://h.foo/", page.format(f"n{i}", i % 2)) for i in range(16)] + [(20, None, None), (21, "http://h.foo/", ""), (22, "u://v", "plain <b>text</b> <script>x"), (22, "u://v", "plain <b>text</b> <script>x")]
    got = {r.page_id: r.text for r in site_style.extract(frame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[3] == "Text n3 & more of it\nn3" and got[20] == got[21] == "" and got[22] == "plain text"
    nodes = site_style.style_tree(frame([("h", r[2]) for r in rows[:16]], "host string, html string")).collect()
    assert min(r.importance for r in nodes) < 1e-9
    assert abs(site_style.importance_of({1: 16}, 16)) < 1e-9 and site_style.importance_of({i: 1 for i in range(16)}, 16) == 1
    assert site_style.extract(frame([], "page_id long, url string, html string")).count() == 0


def test_mirrors_keep_their_text(frame):
    story = lambda c: "".join(f'<p class="x{k}">{c} sentence {k} of a story.</p>' for k in range(5))
    classed = '<body><div class="x9">Site</div><article><p class="lead">{0} leads.</p><div class="body"><p>{0} goes on for longer than it led.</p></div></article></body>'
    plain = '<body><div class="x9">Site of {1}</div><div class="x8">{0}</div></body>'
    flat = "<body><p>{0} one.</p><p>{0} two.</p></body>"
    rows = []
    for i in range(20):
        c = "Copied" if i < 18 else f"Unique{i}"
        rows += [(i, "http://a.foo/", classed.format(c)), (100 + i, "http://b.foo/", plain.format(story(c), i)), (200 + i, "http://c.foo/", flat.format(c))]
    got = {r.page_id: r.text for r in site_style.extract(frame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        c = "Copied" if i < 18 else f"Unique{i}"
        assert got[i] == f"{c} leads.\n{c} goes on for longer than it led."
        assert got[100 + i].endswith("\n".join(f"{c} sentence {k} of a story." for k in range(5)))
        assert got[200 + i] == f"{c} one.\n{c} two."


def test_furniture():
    page = """<html><head><title>x</title></head><body class="with-sidebar"><header>Top</header><div id="cookie-notice">c</div><div class="story"><h1>T</h1><p>a 1 < 2</p>
    <form>f<input></form></div><div class="comments"><article class="comment"><p>nice</p></article></div><aside>s</aside></body></html>"""
    assert [b.text for b in site_style.parse(page)[0] if not b.furniture] == ["T", "a 1 < 2"]


def test_classes_do_not_hide_the_article():
    def own(inner):
        return [b.text for b in site_style.own_text(site_style.parse(f"<body><nav>n</nav>{inner}<footer>f</footer></body>")[0])]

    article = "<article><h1>T</h1><p>some text</p></article>"
    for page in (
        '<main class="with-sidebar"><h1>T</h1><p>some text</p></main>', f'<div id=content class="no-sidebar">{article}</div>', '<div class="page has-header"><h1>T</h1><p>some text</p></div>',
        '<div class="page header-fixed"><h1>T</h1><p>some text</p></div>', '<article class="post tags"><h1>T</h1><p>some text</p></article>', f'<div class="content right-sidebar">{article}<div class="sidebar">s</div></div>',
        f'<main><div class="page header-fixed">{article}</div></main>', '<article><div class="entry-header"><h1>T</h1></div><p>some text</p><div class="newsletter">t</div></article>',
        f'{article}<div class="sidebar"><article><p>a</p></article></div>', f'<div class="comments"><article class="comment"><p>a much longer comment</p></article></div>{article}',
        '<div class="header"><h1>Site</h1></div><div><h1>T</h1><p>some text</p></div>',
    ):
        assert own(page) == ["T", "some text"], page
    assert own("<noscript>js</noscript><article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><text>label</text></svg><noscript>plain</noscript></article>") == ["so x=2 holds", "label", "plain"]


def test_words_of_an_article_stay(frame):
    kept = ['<p class="form">A poem</p>', '<section class="legal"><p>A law</p></section>', '<div id="search-results"><p>Found</p></div>', '<p class="notice">Noticed</p>', '<div class="tags">Cats</div>']
    gone = ['<div class="ad">Buy</div>', '<div class="comments"><p>Nice</p></div>', '<form>Name</form>', '<div class="sidebar">Side</div>', '<div class="notice">We use them</div>', '<nav>Menu</nav>']
    rows = [(i, "http://h.foo/", f"<body><article><h1>T{i}</h1>{''.join(kept + gone)}<p>End</p></article></body>") for i in range(3)]
    got = site_style.extract(frame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"T{i}\nA poem\nA law\nFound\nNoticed\nCats\nEnd" for i in range(3)}


def test_the_tree_decides(frame):
    """What its class says is overruled by how often a branch's texts come again: within an article and beside it."""
    page = (
        '<body><article><h1>T{0}</h1><p>Story {0} goes on and on, as long as it likes.</p><div class="share">Tell your friends</div><div class="sidebar">Note {0}</div><section class="x1">Read on</section></article></body>'
    )
    bare = '<body><div class="top1">Our site</div><div class="widget">Tale {0} is told in a widget and is quite long.</div><div class="side">Same</div></body>'
    rows = [(i, "http://h.foo/", page.format(i)) for i in range(20)] + [(100 + i, "http://g.foo/", bare.format(i)) for i in range(20)]
    df = frame(rows, "page_id long, url string, html string")
    on = {r.page_id: r.text for r in site_style.extract(df).collect()}
    off = {r.page_id: r.text for r in site_style.extract(df, least_pages=10**9).collect()}
    assert on[3] == "T3\nStory 3 goes on and on, as long as it likes.\nNote 3" and on[103] == "Tale 3 is told in a widget and is quite long."
    assert off[3] == "T3\nStory 3 goes on and on, as long as it likes.\nTell your friends\nRead on" and off[103] == "Our site"


def test_branches_of_few_pages_of_a_large_host(frame):
    """A host's size decides nothing: what eight of 2,000 pages have is judged as on a host of eight, page by page."""
    page = '<body><nav>Menu</nav><div class="story"><p>Tale {0} is told here and is quite long.</p></div>{1}</body>'
    rare = ('<div class="x1">Same words</div><div class="x2">Own {0}</div>', '<div class="widget">Note {0}</div><div class="sidebar">Side</div>', '<div class="x3">Seven {0}</div><div class="widget">Two</div>')
    rows = [(i, "http://h.foo/", page.format(i, rare[0].format(i) if i < 8 else rare[1].format(i) if i < 17 else rare[2].format(0) if i < 24 else "")) for i in range(2000)]
    rows += [rows[0], (3000, "http://H.foo/x", rows[1][2]), (3001, "http://g.foo/", rows[0][2])]
    df = frame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in site_style.extract(df).collect())
    nodes = site_style.style_tree(frame([("g" if "g.foo" in r[1] else "h", r[2]) for r in rows], "host string, html string")).where("pages >= 8").collect()
    low = {x.node for x in nodes if x.importance < (site_style.SURE if x.node % 2 else site_style.LEAST_IMPORTANCE)}
    sure = {x.node for x in nodes if x.node % 2} - low
    want = lambda r: "\n".join(x.text for x in site_style.kept_of(site_style.parse(r[2])[0], *((low, sure) if "g.foo" not in r[1] else (set(), set()))))
    assert got == sorted((r[0], want(r)) for r in rows)
    text = dict(got)
    tale = "Tale {} is told here and is quite long."
    assert text[3] == f"{tale.format(3)}\nOwn 3" and text[9] == f"{tale.format(9)}\nNote 9" and text[500] == tale.format(500)
    assert text[3000] == f"{tale.format(1)}\nOwn 1" and text[3001] == f"{tale.format(0)}\nSame words\nOwn 0"


def test_importance_against_brute_force(frame):
    """Entropies from lists of all contents of all pages."""
    import math
    import random

    r = random.Random(2)
    rows = [("ab"[i % 3 == 0], "".join(f'<div class="c{k}">{r.choice("xyzuvw")}<b class=i>{r.choice("pq")}</b></div>' for k in range(r.randrange(4)))) for i in range(60)]
    told = {(x.host, x.node): (x.pages, x.importance) for x in site_style.style_tree(frame(rows, "host string, html string")).collect()}
    distinct, want = {}, {}
    for host, page in rows:
        blocks, children = site_style.parse(page)
        distinct.setdefault((host, "\n".join(b.text for b in blocks)), []).append((sorted({(node, b.text) for b in blocks for node in b.chain}), {n for b in blocks for n in b.chain}, children))
    for (host, _), same in distinct.items():
        for contents, nodes, children in same[:1]:
            for node in nodes:
                want.setdefault((host, node), [[], 0])[1] += 1
                want[host, node][0] += [t for n, t in contents if n == node]
    checked = 0
    for at, (texts, pages) in want.items():
        if pages > 1:
            n = [texts.count(t) for t in set(texts)]
            entropy = -sum(x / len(texts) * math.log(x / pages) for x in n) / math.log(pages)
            assert told[at][0] == pages and abs(told[at][1] - entropy) < 1e-9
            checked += 1
    assert checked >= 4


def test_broken_pages_take_time_in_proportion():
    import time

    for unit in ("<a", "<div>x", "<title>", "<script ", "<!--", "<!", '<a "', "<p>x", "<b c>", "</x>", "<h1>a", "<ul>", "<a b='c\"", "<article>x", "</title"):
        for page in (unit * (1_000_000 // len(unit)), unit * (300_000 // len(unit)) + ">" + "<p>" + "<b c>" * 20_000 + unit * (300_000 // len(unit))):
            began = time.process_time()
            site_style.parse(page)
            url_filter.targets(page)
            assert time.process_time() - began < 6, unit


def test_very_long_pages(frame):
    body = "<p>word</p>" * 50_000
    rows = [(1, "http://h.foo/", f"<article>{body}</article>"), (2, "http://h.foo/2", f"<div>{body}<link rel=canonical href='http://x.org/es/'>")]
    df = frame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style.extract(df).collect()}
    assert got[1] == got[2] == "\n".join(["word"] * 50_000)
    assert {r.page_id: r.verdict for r in url_filter.judge(df).collect()} == {1: "allow", 2: "block"}


def test_many_rules_give_what_a_literal_gives(frame):
    import random

    r = random.Random(1)
    part = lambda: r.choice(["a", "b", "c.d", "e"])
    rules = list({f"{part()}.{part()}/{r.choice(['', 'x', 'x/y', 'z'])}": r.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(action, rule) for rule, action in rules] + [("block", "tie.a/"), ("allow", "tie.a/")]
    rows = [(i, f"http://{part()}.{part()}.{part()}/{r.choice(['', 'x', 'xy', 'x/y/z', 'zz'])}", None) for i in range(200)] + [(300, "u://tie.a/", None), (301, None, None), (302, "u://tie.a", None)]
    df = frame(rows, "page_id long, url string, html string")
    by_table = url_filter.judge(df, df.sparkSession.createDataFrame(rules, "action string, rule string"))
    assert sorted(map(str, by_table.collect())) == sorted(map(str, url_filter.judge(df, rules).collect()))
    assert by_table.where("rule is not null").count() > 20


def test_streams_without_roles_and_repeated_events(frame):
    e = [(1, 0, 0, "delta", None, "a"), (1, 0, 1, "delta", "", "b"), (1, 0, 1, "delta", "", "b"), (2, 0, 0, "start", "user", "x"), (2, 0, 1, "delete", None, None), (2, 0, 2, "delta", None, "lost")]
    events = frame(e, "conv_id long, message long, seq long, kind string, role string, text string")
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.rebuild(events).collect()} == {1: [("", "ab")], 2: []}


def test_turns_as_streams(frame):
    long = "x<[\\" * 50_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 1, "assistant", long), (1, None, None, None), (2, 0, "assistant", None), (2, 1, "assistant", "a"), (2, 2, "user", "b")]
    events = chat.streamed(frame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, step int"))
    assert {"start", "delta", "regenerate", "edit"} == {r.kind for r in events.collect()}
    back = chat.read(chat.render(chat.rebuild(events))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back} == {
        1: [("", ""), ("user", "hi"), ("assistant", long), ("assistant", long)], 2: [("assistant", ""), ("assistant", "a"), ("user", "b")],
    }
    assert {r.conv_id: r.loss_text for r in back} == {1: long + long, 2: "a"}


def test_events_fold_to_messages(frame):
    e = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "start", "assistant", ""), (1, 1, 2, "delta", None, "wro"), (1, 1, 3, "delta", None, "ng"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 6, "delta", None, "lo"), (1, 1, 5, "delta", None, "hel"), (1, 2, 7, "start", "user", "x"), (1, 2, 8, "edit", None, "y<"), (1, 3, 9, "start", "assistant", "gone"), (1, 3, 10, "delete", None, None),
        (2, None, None, None, None, None), (None, 0, 0, "message", "user", "\\l[INST]</s>"),
    ]
    events = frame([(*x, 7) for x in e], "conv_id long, message long, seq long, kind string, role string, text string, turns int")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read(chat.render(chat.rebuild(events))).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "hello"), ("user", "y<")], 2: [("", "")], None: [("user", "\\l[INST]</s>")]}
    for r in chat.render(chat.rebuild(events)).collect():
        assert r.formatted.count("</s>") == len(got[r.conv_id]) and r.formatted.count("<s>") == 1
    assert chat.rebuild(frame([], events.schema)).count() == 0


def test_chat_query_has_the_planted_conversation(spark):
    r = queries.op7_chat_format(spark, P).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, 21)


def test_topk_against_all_distances(frame):
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 40))
    v[50:90] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (900, None), (1000, []), (1100, [1.0, -1.0]), (None, [1.0] * 40), (1200, [None] * 40)]
    df = frame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, distance int")
    asked = df.where("vec_id % 10 = 0")
    for block in (64, 1000):
        got = {}
        for x in topk.search(df, asked, 5, block=block).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.distance, x.neighbour_id))
        for q in range(0, 300, 10):
            near = sorted((int(((np.array(x) >= 0) != (v[q] >= 0)).sum()), i) for i, x in rows if i is not None and x and len(x) == 40 and x[0] is not None)[:5]
            assert sorted(got[q]) == [(k + 1, *n) for k, n in enumerate(near)]
        assert got[1100] == [(1, 0, 1100)] and 900 not in got
    assert topk.search(frame([], "vec_id long, embedding array<double>"), frame([], "vec_id long, embedding array<double>")).count() == 0

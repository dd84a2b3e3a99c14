"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: nodes are paths of elements by tag, class, id and role, so
siblings of one kind are one node. Each node keeps how often each content (a block's text) and each
presentation (the kinds of its children) occurs on the host's pages. A node's importance falls with the
entropy of its contents over pages: 1 if each is on one page only, 0 if all are on every page; where a
node has no text of its own, its presentations count alike. Branches of low importance that are seen on
enough pages are removed from each page, as are elements whose presentation names them as furniture
(navigation, footer, advert, form, comments ...). If a page has an article (or main) element, its text
is in there; that element and its plain children (paragraphs, headings, lists) are never removed for
being like those of other pages, as copies of an article are still articles. For the same reason pages
of a host with the same own text (the article's, or all but furniture) count once, and a branch that
holds more than half of a page's own text stays on that page (whole, if more than half of it would go).

Trees are counts by (host, node, content), summed before and after a shuffle, over one page of each
(host, own text); a host's branches to remove go to its pages by a join on host and a salt, so a host
with a third of all pages is spread out. Only branches that one in SHARE of a host's pages has travel so,
which bounds the list; the rest are joined with the nodes of each page, and go to the pages that have them.

Edge cases: null and empty html have empty text; null urls count as one host; broken or unclosed markup
is read as far as it goes; repeated pages give repeated rows; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_batches, written
from .url_filter import host_of

LEAST_PAGES = 8  # of a node, before its statistics remove it
LEAST_IMPORTANCE = 0.35
SURE = 0.6  # importance of a branch whose class or id sounds like furniture
SHARE = 200  # branches that fewer pages than one in so many have are joined page by page
SALTS = 32
FLUSH = 200_000

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile("[\"']")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe select".split())
_MATH = "annotation annotation-xml math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
_INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tspan tt u var wbr {_MATH}".split())
_SPACED = frozenset("annotation annotation-xml br mtd".split())  # inline, but no part of the word before
_FURNITURE_TAGS = frozenset("nav footer aside form button dialog head menu object audio video canvas".split())
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|menu|nav\w*|breadcrumbs?|sidebar|side|footer|foot|header|masthead|"
    r"comments?|commentlist|disqus|reply|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|form|widget|toolbar|pagination|pager|tags|copyright|legal|skip)(?=$|[\s_-])",
    re.I,
)
_MODIFIER = re.compile(r"(?:with|without|has|no)[_-]\S*")  # a layout's word about other elements
_ASIDE = re.compile(r"(?<!\S)(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus|reply|replies|respond|related|recommend\w*)(?!\S)")  # furniture though it holds articles
_WEAK = frozenset("alert banner copyright foot form header legal masthead overlay reply respond search share side skip tags widget".split())  # may be an article's words too
_TEXT = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())  # elements of an article's own text
_OUTSIDE = frozenset("header noscript svg".split())  # furniture outside an article only
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_MAIN = frozenset("article main".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
DEPTH = 64  # of the tree: elements that lie deeper are read as parts of the one at this depth


class Block:
    """A block of text. chain: nodes above it that may be removed for low importance; suspects: those whose class or id
    sounds like furniture; shut: whether it is furniture by tag, role or as comments; main: whether it is in an article."""

    __slots__ = ("chain", "suspects", "main", "text", "shut")

    def __init__(self, chain: tuple[int, ...], suspects: tuple[int, ...], main: bool, text: str, shut: bool) -> None:
        self.chain, self.suspects, self.main, self.text, self.shut = chain, suspects, main, text, shut

    @property
    def furniture(self) -> bool:
        """What its tags and names alone say."""
        return self.shut or bool(self.suspects)


class Element:
    """An element below up. node is the hash of its path, odd if its class or id sounds like furniture; soft says how much
    so (1: may be an article's word too, 2), hard that it is furniture by tag, role or as comments, main that it is an
    article or main, named that it has a class or an id. base: the nearest paragraph or block at or above; top: the
    nearest main; clean: whether nothing hard or soft is below that; head: the outermost h1; barred: whether anything
    hard is at or above. The rest is what ``_settle`` passes on to blocks."""

    __slots__ = ("tag", "up", "depth", "node", "hard", "soft", "main", "named", "base", "top", "clean", "head", "barred", "shut", "within", "chain", "suspects")

    def __init__(self, tag: str, up: Element | None, node: int, hard: bool = False, soft: int = 0, main: bool = False, named: bool = False) -> None:
        self.tag, self.up, self.node, self.hard, self.soft, self.main, self.named = tag, up, node, hard, soft, main, named
        self.depth = up.depth + 1 if up else 0
        self.base = self if tag == "p" or tag not in _INLINE or not up else up.base
        self.top = self if main else up.top if up else None
        self.clean = main or bool(up and up.clean and not hard and not soft)
        self.head = up.head if up and up.head else self if tag == "h1" else None
        self.barred = hard or bool(up and up.barred)
        self.shut, self.within, self.chain, self.suspects = False, False, (), ()


def _open_up(elements: list[Element], found: dict[Element, int], most: bool) -> None:
    """Classes do not make furniture of what holds the elements found (and the characters of their text), if those are
    without mark nowhere else (or, with most, of less text)."""
    marked: dict[Element, bool] = {}
    for e in elements:
        marked[e] = bool(e.up and marked[e.up]) or e.soft > 0
    found = {e: n for e, n in found.items() if not e.barred}
    closed = [e for e in found if marked[e]]
    free = sum(found.values()) - sum(found[e] for e in closed)
    if not free or most and sum(found[e] for e in closed) > free:
        done: set[Element] = set()
        for e in closed:
            while e and e not in done:
                done.add(e)
                e.soft = 0
                e = e.up


def _settle(elements: list[Element]) -> None:
    """What each element passes to the blocks in it, from the root down."""
    chains: dict[tuple[int, int], tuple[int, ...]] = {}
    for e in elements:
        up = e.up
        if not up:
            continue
        e.shut = up.shut or e.hard or e.tag in _OUTSIDE and not up.within
        suspect = e.soft > (1 if up.within else 0) and e.depth <= DEPTH
        e.suspects = up.suspects + (e.node,) if suspect else up.suspects
        own = e.main and not e.shut and not e.suspects
        e.within = up.within or own
        e.chain = up.chain
        if not own and e.depth <= DEPTH and e.tag not in ("html", "body") and (not up.within or e.named):
            at = (id(up.chain), e.node)
            e.chain = chains[at] = chains.get(at) or (*up.chain, e.node)


class _Reader:
    """Finds the tags of a page in one pass: what is found not to end is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.quoted, self.unclosed = page, True, set()

    def end(self, at: int) -> int:
        """Where the tag ends that begins before ``at``: its >, outside quotes if quotes end; -1 without any."""
        page, first = self.page, self.page.find(">", at)
        end, at = first, at
        while self.quoted and end >= 0:
            q = _QUOTE.search(page, at, end)
            if not q:
                return end
            at = page.find(q[0], q.end()) + 1
            end = page.find(">", max(at, end)) if at else -1
            self.quoted = end >= 0
        return first

    def after(self, tag: str, at: int) -> int:
        """Behind the closing tag; -1 without."""
        if tag not in self.unclosed:
            m = re.compile(rf"</{tag}\b", re.I).search(self.page, at)
            end = self.page.find(">", m.end()) if m else -1
            if end >= 0:
                return end + 1
            self.unclosed.add(tag)
        return -1


def parse(page: str | None) -> tuple[list[Block], dict[int, set[int]]]:
    """Blocks in page order, and the kinds of children of each node. Time and memory grow with the length of a page."""
    children: dict[int, set[int]] = {}
    if not page:
        return [], children
    root = Element("", None, 0)
    elements, stack, opened = [root], [root], Counter()
    texts: list[tuple[Element, str]] = []
    words: list[str] = []
    mains: dict[Element, int] = {}  # articles and characters of their text
    heads: dict[Element, int] = {}  # h1 elements, likewise

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if text:
                e = stack[-1]
                texts.append((e, text))
                if e.top and e.clean:
                    mains[e.top] = mains.get(e.top, 0) + len(text)
                if e.head:
                    heads[e.head] = len(text)

    def close(tag: str) -> None:
        while opened[tag]:
            opened[(e := stack.pop()).tag] -= 1
            if e.tag == tag:
                break

    reader, at, end = _Reader(page), 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            words.append(page[at:])
            break
        words.append(page[at:start])
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        m = _TAG.match(page, start + 1, start + 64)
        if not m and page[start + 1 : start + 2] not in ("!", "?"):
            words.append("<")
            at = start + 1
            continue
        stop = reader.end(start + 1) if m else page.find(">", start)
        if stop < 0:
            words.append(page[start:])
            break
        at = stop + 1
        if not m:
            continue
        m = _TAG.match(page, start + 1, stop)
        tag, attributes = m[2].lower(), page[m.end() : stop]
        if tag not in _INLINE:
            flush()
        elif tag in _SPACED:
            words.append(" ")
        if m[1]:
            close(tag)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                behind = reader.after(tag, at)
                at = behind if behind >= 0 else end if tag in ("script", "style") else at
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _INLINE and not attributes:
            continue
        if tag in _CLOSES_P:
            while stack[-1].base.tag == "p":
                close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            close(tag)
        named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attributes)} if attributes else {}
        up, role, names = stack[-1], named.get("role"), f"{named.get('class', '')} {named.get('id', '')}"
        main = tag in _MAIN or role == "main"
        hard, soft = False, 0
        if tag not in ("html", "body"):
            aside = bool(named and tag != "main" and role != "main" and _ASIDE.search(names))
            hard = aside or not main and (tag in _FURNITURE_TAGS or role in _FURNITURE_ROLES)
            said = [x.strip(" \t\r\n\f_-").lower() for x in _FURNITURE.findall(_MODIFIER.sub("", names))] if named and not main and not hard else []
            soft = 2 if tag not in _TEXT and not _WEAK.issuperset(said) else 1 if said else 0
        node = up.node
        if up.depth < DEPTH:
            label = f"{tag}.{' '.join(sorted(named.get('class', '').split()))}#{re.sub(r'[0-9]+', '', named.get('id', ''))}"
            node = xxhash.xxh64_intdigest(f"{up.node}/{label}") >> 2 << 1 | (soft > 0)
            if tag not in _INLINE:
                children.setdefault(up.node, set()).add(node)
        e = Element(tag, up, node, hard, soft, main, bool(named.get("class") or named.get("id")))
        elements.append(e)
        stack.append(e)
        opened[tag] += 1
    flush()
    _open_up(elements, mains, True)
    _open_up(elements, {e: n for e, n in heads.items() if e.top and not e.barred} or heads, False)
    _settle(elements)
    return [Block(e.chain, e.suspects, e.within, text, e.shut) for e, text in texts], children


def _content(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def own_text(blocks: list[Block]) -> list[Block]:
    """Blocks that are not furniture: those of the article if there are any."""
    kept = [x for x in blocks if not x.furniture]
    return [x for x in kept if x.main] or kept


def page_trees(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """host, page (a hash of the html), copy (a hash of the own text) and tree (pairs of node and content) of each page."""

    def trees(batches):
        for b in batches:
            copies, packed = [], []
            for page in b.column(2).to_pylist():
                blocks, children = parse(page)
                each = {(block.chain, _content(block.text)) for block in blocks}
                seen = {(node, 0) for chain in {chain for chain, _ in each} for node in chain}  # content 0: that the page has the node
                seen |= {(node, content) for chain, content in each for node in chain}
                leaves = {node for node, content in seen if content}
                seen |= {(node, sum(kids) & (2**63 - 1)) for node, kids in children.items() if node not in leaves}
                own = [x for x in blocks if not x.shut]  # whatever names say of it
                copies.append(_content("\n".join(x.text for x in [x for x in own if x.main] or own)))
                packed.append(np.array(sorted(seen), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(copies, pa.int64()), pa.array(packed, pa.binary())], names=["host", "page", "copy", "tree"])

    each = pages.select(F.col(host).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    return each.transform(in_batches, trees, "host string, page long, copy long, tree binary")


def style_tree(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """host, node, pages and importance of each node of each host's tree; pages of the same own text count once."""
    return _merged(page_trees(pages, host, html))


def _merged(trees: DataFrame) -> DataFrame:
    """The nodes of ``style_tree`` from the trees of pages."""

    def count(batches):
        sums: dict[tuple[str, int, int], int] = {}
        for b in batches:
            for name, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for node, content in np.frombuffer(tree, np.int64).reshape(-1, 2).tolist():
                    at = (name, node, content)
                    sums[at] = sums.get(at, 0) + 1
                if len(sums) > FLUSH:
                    yield rows(sums)
                    sums = {}
        yield rows(sums)

    def rows(sums):
        columns = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], names=["host", "node", "content", "n"])

    distinct = trees.groupBy("host", "copy").agg(F.min("tree").alias("tree")).select("host", "tree")
    each = distinct.transform(in_batches, count, "host string, node long, content long, n long").groupBy("host", "node", "content").agg(F.sum("n").alias("n"))
    own = F.col("content") != 0
    nodes = each.groupBy("host", "node").agg(
        F.max(F.when(~own, F.col("n"))).alias("pages"), F.sum(F.when(own, F.col("n"))).alias("all"), F.sum(F.when(own, F.col("n") * F.log("n"))).alias("entropy")
    )
    # mean entropy of the contents over the pages that have the node, each weighed by its pages
    return nodes.where("pages > 1 and all > 0").select("host", "node", "pages", (1 - F.col("entropy") / F.col("all") / F.log(F.col("pages").cast("double"))).alias("importance"))


def kept_of(blocks: list[Block], low: set[int], sure: set[int]) -> list[Block]:
    """The page's own text without its branches in low. Branches whose names alone sound like furniture are own text if
    they are in sure. A branch of more than half of that text stays, and the smallest such (or the article) stays whole
    if more than half of it would go."""
    kept = [x for x in blocks if not x.shut and sure.issuperset(x.suspects)]
    own = [x for x in kept if x.main] or kept
    if low.isdisjoint(node for x in own for node in x.chain):
        return own
    held: dict[int, int] = {}
    for x in own:
        for node in x.chain:
            held[node] = held.get(node, 0) + len(x.text)
    size = sum(len(x.text) for x in own)
    heavy = [node for node, n in held.items() if 2 * n > size]
    low = low.difference(heavy)
    if heavy:
        least = min(heavy, key=held.__getitem__)
        branch = [x for x in own if least in x.chain]
    else:
        branch = [x for x in own if x.main]
    if 2 * sum(len(x.text) for x in branch if low.isdisjoint(x.chain)) < sum(len(x.text) for x in branch):
        low = low.difference(node for x in branch for node in x.chain)
    return [x for x in own if low.isdisjoint(x.chain)]


def _salted(rows: DataFrame, by: list[str], lists: DataFrame, how: str) -> DataFrame:
    """rows joined with the lists of their host; those of a host are spread over SALTS by other columns."""
    copies = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], how)


def _of_pages(trees: DataFrame, judged: DataFrame, rare: DataFrame) -> DataFrame:
    """host, page, and the nodes of rare that each page has: rare_low and rare_sure. Only nodes that are not often there
    are looked for, so no node of a whole host meets in one place."""

    def run(batches):
        for b in batches:
            usual, at = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            rows: list[tuple[str, int, int]] = []
            for i, (name, page, tree) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)))):
                own = np.frombuffer(tree, np.int64).reshape(-1, 2)
                own = own[own[:, 1] == 0, 0]  # each node of a page once
                rows += [(name, page, node) for node in own[~np.isin(own, usual[at[i] : at[i + 1]])].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["host", "page", "node"])

    usual = judged.groupBy("host").agg(F.collect_list(F.when(F.col("often"), F.col("node"))).alias("usual"), F.max(~F.col("often") & (F.col("low") | F.col("high"))).alias("more"))
    each = _salted(trees, ["page"], usual.where("more").select("host", "usual"), "inner").select("host", "page", "tree", "usual")
    got = each.transform(in_batches, run, "host string, page long, node long").distinct().join(rare.select("host", "node", "low"), ["host", "node"])
    return got.groupBy("host", "page").agg(F.collect_list(F.when(F.col("low"), F.col("node"))).alias("rare_low"), F.collect_list(F.when(~F.col("low"), F.col("node"))).alias("rare_sure"))


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, sure: float = SURE
) -> DataFrame:
    """key, url and text of each page. A branch is judged if least_pages of its host have it."""
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page"))
    trees = written(page_trees(own), "trees")
    nodes = written(_merged(trees), "styles")
    often = F.col("pages") >= F.ceil(F.col("most") / SHARE)  # each page has few kinds of branches, so few are in 1 of SHARE
    suspect = F.col("node") % 2 == 1
    # what sounds like furniture has to be as important as text is
    low, high = F.col("importance") < F.when(suspect, sure).otherwise(least_importance), suspect & (F.col("importance") >= sure)
    judged = nodes.where(F.col("pages") >= least_pages).join(nodes.groupBy("host").agg(F.max("pages").alias("most")), "host")
    judged = written(judged.select("host", "node", often.alias("often"), low.alias("low"), high.alias("high")), "judged")
    rare = judged.where("not often and (low or high)")
    listed = lambda on, name: F.collect_list(F.when(F.expr(on), F.col("node"))).alias(name)
    told = judged.where("low or high").groupBy("host").agg(listed("often and low", "low"), listed("often and high", "sure"), F.max(~F.col("often")).alias("more"))
    joined = _salted(own, ["k", "u"], told, "left")
    out = joined.select("k", "u", "html", "low", "sure")
    if not rare.isEmpty():
        found = written(_of_pages(trees, judged, rare), "rare")
        both = joined.where("more").join(found, ["host", "page"], "left")
        with_rare = [F.concat(x, F.coalesce(f"rare_{x}", F.array().cast("array<long>"))).alias(x) for x in ("low", "sure")]
        out = joined.where("more is null or not more").select(*out.columns).union(both.select("k", "u", "html", *with_rare))
    discard(trees, nodes)

    def run(batches):
        for b in batches:
            texts = ["\n".join(x.text for x in kept_of(parse(page)[0], set(low or ()), set(high or ()))) for page, low, high in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["k", "u", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return out.transform(in_batches, run, f"k {kind}, u string, text string").select(F.col("k").alias(key), F.col("u").alias(url), "text")


def importance_of(counts: dict[int, int], pages: int) -> float:
    """Importance of a node from the pages that each of its contents is on; the formula of ``style_tree``."""
    n = np.array(list(counts.values()), float)
    return float(1 - (n * np.log(n)).sum() / n.sum() / np.log(pages))

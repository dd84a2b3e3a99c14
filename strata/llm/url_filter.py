"""URL filter with redirect equivalence.

A URL is judged by the longest rule that fits its host (or a parent domain) and the start of its path.
Pages without a rule take the decision of their aliases: canonical links and refresh redirects in the
pages make edges between URLs, connected components over the edges are the classes of aliases, and a
class with a blocked URL is blocked, unless one of its URLs is explicitly allowed: allow goes before
block. URLs are nodes by host, path and query; an alias need not be a page of the table.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and has no alias;
null html has no links; very long pages are read whole, in one pass; repeated pages give repeated rows; of rules that are equal but for their
action, allow wins; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from contextlib import suppress
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .graph import SALTS, components, copies, heavy_keys, spread

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LITERAL = 1_000  # rules that are tried one after another


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.translate(host, string.ascii_uppercase, string.ascii_lowercase))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and action; null if none does. Rules are a literal, tried in order."""
    known = F.array(*[
        F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit(f"/{r.partition('/')[2]}").alias("path"), F.lit(r).alias("rule"), F.lit(action).alias("action"))
        for action, r in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow"))
    ])
    return F.get(F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])), F.lit(0))


_OPEN = re.compile(r"<(?:(!--)|(script|link|meta)\b)", re.I)
_SCRIPT_END = re.compile(r"</script\s*+>", re.I)
_ATTRIBUTE = re.compile(r"""(?<![a-z-])([a-z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_REFRESH = re.compile(r"""\burl\s*+=\s*+['"]?\s*+([^'"\s]+)""", re.I)


def targets(html: str) -> list[str]:
    """What a page's canonical links and refresh redirects name, in one pass; comments and scripts are skipped, and one
    that is not closed, or a tag that is not, ends the page."""
    out, at = [], 0
    while m := _OPEN.search(html, at):
        tag = (m[2] or "").lower()
        if not tag:
            at = html.find("-->", m.end()) + 3
            if at < 3:
                break
        elif tag == "script":
            end = _SCRIPT_END.search(html, m.end())
            if not end:
                break
            at = end.end()
        else:
            at = html.find(">", m.end()) + 1
            if not at:
                break
            named = {k.lower(): unescape(x or y or z).strip() for k, x, y, z in _ATTRIBUTE.findall(html[m.end() : at - 1])}
            if tag == "link" and "canonical" in named.get("rel", "").lower().split():
                out.append(named.get("href", ""))
            elif tag == "meta" and named.get("http-equiv", "").lower() == "refresh" and (refresh := _REFRESH.search(named.get("content", ""))):
                out.append(refresh[1])
    return [x for x in out if x]


def aliases(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges a, b between URLs (as host, path and query): canonical links and refresh redirects."""

    def run(batches):
        for b in batches:
            pairs = []
            for u, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in targets(page):
                    with suppress(ValueError):  # a target that is no URL
                        pairs.append((u, urljoin(u, x)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["u", "x"])

    has = F.lower(html)
    some = pages.where((has.contains("canonical") | has.contains("refresh")) & F.col(url).contains("://"))
    links = some.select(url, html).transform(in_batches, run, "u string, x string")
    return links.select(_node(F.col("u")).alias("a"), _node(F.col("x")).alias("b")).where("a <> '' and b <> ''").distinct()


def _node(url: Column) -> Column:
    """Host, path and query, separated; empty without a host."""
    return F.when(host_of(url) == "", "").otherwise(F.concat(host_of(url), F.lit("\n"), path_of(url), F.lit("\n"), query_of(url)))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (host, path and other columns) with r, the longest rule that fits (rule and action) or null.

    rules: (action, rule) pairs, or a DataFrame of these columns. Up to LITERAL pairs are a literal; any more are joined:
    each host is looked up by its suffixes, each path by its prefixes of the lengths that rules of that suffix have."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= LITERAL:
            return urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame([(r[0], r[1]) for r in rules], "action string, rule string")
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise("/")
    table = rules.select(host.alias("suffix"), path.alias("prefix"), "rule", (F.col("action") == "allow").alias("allow")).groupBy("suffix", "prefix", "rule").agg(F.max("allow").alias("allow"))
    sizes = table.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    distinct = written(urls.select("host", "path").distinct(), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = distinct.select("host", "path", F.explode(suffixes).alias("suffix"))
    heavy = heavy_keys(tried, "suffix")
    by_host = spread(tried, "suffix", heavy, "path").join(copies(sizes, "suffix", heavy), ["suffix", "salt"]).drop("salt")
    prefixes = by_host.select("host", "path", "suffix", F.explode("sizes").alias("size")).where(F.length("path") >= F.col("size")).withColumn("prefix", F.substring("path", F.lit(1), F.col("size")))
    prefixes = written(prefixes.select("host", "path", F.concat("suffix", "prefix").alias("start"), "suffix", "prefix"), "prefixes")
    heavy = heavy_keys(prefixes, "start")
    known = copies(table.withColumn("start", F.concat("suffix", "prefix")), "start", heavy)
    fits = spread(prefixes, "start", heavy, "path").join(known, ["start", "suffix", "prefix", "salt"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "allow", "rule")).alias("b"))
    action = F.when(F.col("b.allow"), "allow").otherwise("block")
    best = best.select(F.concat("host", F.lit("\n"), "path").alias("url"), F.struct(F.col("b.rule").alias("rule"), action.alias("action")).alias("r"))
    own = urls.withColumn("url", F.concat("host", F.lit("\n"), "path"))
    heavy = heavy_keys(own, "url")
    return spread(own, "url", heavy, urls.columns[0]).join(copies(best, "url", heavy), ["url", "salt"], "left").select(*urls.columns, "r")


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule and verdict of each page. rules as in ``with_rule``."""
    linked = components(aliases(pages, url, html))
    parts = F.split("node", "\n")
    own = written(with_rule(linked.select("node", "component", parts[0].alias("host"), parts[1].alias("path")), rules).select("node", "component", F.col("r.action").alias("action")), "own")
    classes = own.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    heavy = heavy_keys(own, "component")
    told = copies(classes.where("blocked and not coalesce(allowed, false)"), "component", heavy)
    blocked = spread(own, "component", heavy, "node").join(told, ["component", "salt"]).select("node", F.lit("block").alias("passed"))
    u = F.col("u")
    asked = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).select("k", host_of(u).alias("host"), path_of(u).alias("path"), _node(u).alias("node"))
    # any url may be that of very many pages: pages are dealt to SALTS parts, each with a copy of the few blocked aliases
    salt = F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")
    spread_out = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = with_rule(asked, rules).withColumn("salt", salt).join(spread_out, ["node", "salt"], "left")
    verdict = F.coalesce(F.col("r.action"), F.col("passed"), F.lit("allow"))
    return judged.select(F.col("k").alias(key), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS tail FROM pages),
h AS (
  SELECT page_id, html, url, tail, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '^[^?#]*(\?[^#]*)', 1) AS query FROM p),
n AS (SELECT *, CASE WHEN host = '' THEN '' ELSE host || chr(10) || path || chr(10) || query END AS node FROM h),
t AS (SELECT node AS a, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM n WHERE node <> ''),
g AS (
  SELECT a, replace(CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\b') AND regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) ELSE '' END, '&amp;', '&') AS target FROM t),
e AS (
  SELECT a, lower(regexp_extract(target, '://([^/?#]*)', 1)) || chr(10) || regexp_extract(target, '://[^/?#]*([^?#]*)', 1) || chr(10) || regexp_extract(target, '^[^?#]*(\?[^#]*)', 1) AS b
  FROM g WHERE contains(target, '://')),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS node, a AS reached FROM s UNION SELECT c.node, s.b FROM c JOIN s ON c.reached = s.a),
rules AS (
  SELECT action, rule, split_part(rule, '/', 1) AS rhost, rule[instr(rule, '/'):] AS rpath
  FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('block', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) v(action, rule)),
urls AS (SELECT DISTINCT split_part(x, chr(10), 1) AS host, split_part(x, chr(10), 2) AS path FROM (SELECT node AS x FROM n UNION SELECT reached FROM c) u WHERE x <> ''),
own AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
via AS (
  SELECT c.node, bool_or(own.action = 'block') AND NOT bool_or(own.action = 'allow') AS blocked FROM c JOIN own ON own.host = split_part(c.reached, chr(10), 1) AND own.path = split_part(c.reached, chr(10), 2) GROUP BY c.node)
SELECT n.page_id, n.host, n.path, own.rule, coalesce(own.action, CASE WHEN via.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM n LEFT JOIN own ON own.host = n.host AND own.path = n.path LEFT JOIN via ON via.node = n.node
"""

"""URL filter: a trie over reversed host labels and path segments (radix nodes within a segment), sent to all tasks.

A rule is a host and a path that starts with ``/``. It fits its host and all subdomains where the URL's
path starts with the rule's. The longest fitting rule decides: first the most host labels, then the
longest path; between equal rules, the later one. The trie holds only the rules, so its size is that of the
rule list, which is checked against ``MAX_RULES`` before it is sent.

Null and empty URLs and URLs without ``://`` have an empty host and path and fit no rule. Repeated rows are judged alike, an
empty table gives an empty result, and other columns are left alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules that may be broadcast; a trie of so many stays within a few hundred MB of a worker.
MAX_RULES = 1_000_000
RESULT = "struct<host:string,path:string,rule:string,verdict:string>"
_LOWER = {i: i + 32 for i in range(65, 91)}


class _Paths:
    """Path tree below one host: closed segments, and a radix tree of the rule paths that end within a segment."""

    __slots__ = ("down", "here", "inside")

    def __init__(self):
        self.down: dict[str, _Paths] = {}
        self.here: tuple[str, str] | None = None
        self.inside: _Edge | None = None


class _Edge:
    """A radix tree's edge: its characters, the rule that ends after them, and the edges that follow by first character."""

    __slots__ = ("part", "rule", "next")

    def __init__(self, part: str, rule: tuple[str, str] | None):
        self.part, self.rule, self.next = part, rule, {}

    def add(self, rest: str, rule: tuple[str, str]) -> None:
        """Put in a rule path that follows this edge."""
        at = self
        while rest:
            edge = at.next.get(rest[0])
            if edge is None:
                edge = at.next[rest[0]] = _Edge(rest, None)
            n, most = 0, min(len(edge.part), len(rest))
            while n < most and edge.part[n] == rest[n]:
                n += 1
            if n < len(edge.part):  # part the edge
                head = at.next[rest[0]] = _Edge(edge.part[:n], None)
                edge.part = edge.part[n:]
                head.next[edge.part[0]] = edge
                edge = head
            at, rest = edge, rest[n:]
        at.rule = rule

    def longest(self, path: str, at: int) -> tuple[str, str] | None:
        """The rule of the longest path below this edge that ``path`` goes on with."""
        best, edge = None, self
        while at < len(path) and (edge := edge.next.get(path[at])) is not None and path.startswith(edge.part, at):
            at += len(edge.part)
            best = edge.rule or best
        return best


class Trie:
    """Longest-match lookup of ``(kind, host, path)`` rules."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root: dict = {}
        for kind, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            paths = node.get(None) or node.setdefault(None, _Paths())
            *closed, rest = path.removeprefix("/").split("/")
            for segment in closed:
                paths = paths.down.get(segment) or paths.down.setdefault(segment, _Paths())
            rule = (host + path, kind)
            if rest:
                paths.inside = paths.inside or _Edge("", None)
                paths.inside.add(rest, rule)
            else:
                paths.here = rule

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule's text and kind."""
        if not path.startswith("/"):
            return None
        found, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                found.append(node[None])
        for paths in reversed(found):  # most host labels first
            best, at = None, 1
            while True:
                best = paths.here or best
                best = paths.inside and paths.inside.longest(path, at) or best
                end = path.find("/", at)
                if end < 0 or (paths := paths.down.get(path[at:end])) is None:
                    break
                at = end + 1
            if best:
                return best
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stop = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[stop:]
    for c in "?#":
        path = path.partition(c)[0]
    return rest[:stop].translate(_LOWER), path


def url_verdict(spark: SparkSession, url: Column, rules: list[tuple[str, str, str]], default: str = "allow") -> Column:
    """Struct of host, path, rule (null where none fits) and verdict (``default`` where none fits)."""
    sent = spark.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf(RESULT)
    def judge(urls: pa.Array) -> pa.Array:
        trie, hosts, paths, names, kinds = sent.value, [], [], [], []
        for url in urls.to_pylist():
            host, path = split_url(url)
            rule = trie.match(host, path)
            hosts.append(host)
            paths.append(path)
            names.append(rule and rule[0])
            kinds.append(rule[1] if rule else default)
        return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (hosts, paths, names, kinds)], ["host", "path", "rule", "verdict"])

    return judge(url)


#: The rules of the registered query: kind, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``: page_id, host, path, rule, verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = pages.select("page_id", url_verdict(spark, F.col("url"), RULES).alias("judged"))
    return judged.select("page_id", "judged.*")


OP8_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(kind, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, max_by(kind, length(rhost) * 1000 + length(rpath)) AS kind
      FROM (SELECT DISTINCT page_id, host, path FROM b) x JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT b.page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM b LEFT JOIN m USING (page_id)
"""

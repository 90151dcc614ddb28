"""URL filters: pattern rules behind an index on each rule's rarest literal token.

A rule is a host with an optional path (it fits that host, its subdomains, and
paths that start with its own) or a regular expression with the literal tokens
that every match contains. How often those tokens occur is counted over all
URLs; each rule is filed under its rarest. A URL's tokens fetch the rules filed
under them, and only those run their expression. Of the host rules that fit, the
longest wins (ties: the first in text order); without one, a fitting pattern
blocks; else the URL is allowed.

Null or without ``://``: empty host and path, no rule, allowed. An empty host or
path stays so. Hosts and paths may hold any other characters, line breaks too, and
be of any length: each is read once a candidate rule. Repeated rows each get a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_TOKEN_SQL = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    action: str
    text: str  # host + path for host rules, a name for patterns
    pattern: str  # over host + "/" + path, since no host holds a slash
    tokens: tuple[str, ...]  # literals that every fitting URL has among its tokens
    pattern_only: bool = False


def host_rule(action: str, text: str) -> Rule:
    """text: host/path, as in ``example.org/es/``."""
    host, slash, path = text.partition("/")
    path = slash + path
    literal = _TOKEN.findall(host)
    # the last piece of a path prefix may go on in a URL, so it is no whole token; neither is one with other letters
    inner = [t for t in re.split("[^a-z0-9]+", path)[:-1] if t] if path == path.lower() and path.isascii() else []
    return Rule(action, text, rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(literal + inner))


def pattern_rule(name: str, pattern: str, *tokens: str) -> Rule:
    return Rule("block", name, pattern, tokens, pattern_only=True)


#: The list to judge by.
RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
#: Without a fitting rule: hosts that sell what spam sells.
PATTERNS = (
    pattern_rule("casino", r"(?:[^/]*[^a-z0-9/])?casino(?![a-z0-9])", "casino"),
    pattern_rule("pills", r"(?:[^/]*[^a-z0-9/])?pills(?![a-z0-9])", "pills"),
    pattern_rule("xxx", r"(?:[^/]*[^a-z0-9/])?xxx(?![a-z0-9])", "xxx"),
    pattern_rule("free-money", r"(?:[^/]*[^a-z0-9/])?free-money(?![a-z0-9])", "free", "money"),
)

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_UPPER), m[2]


class Index:
    """Rules filed under their rarest literal token."""

    def __init__(self, rules: Iterable[Rule], seen: dict[str, int]):
        self.filed: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for r in rules:
            entry = (r, re.compile(r.pattern))
            if r.tokens:
                self.filed.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, host: str, path: str) -> list[tuple[Rule, re.Pattern]]:
        found = list(self.always)
        for t in dict.fromkeys(_TOKEN.findall(host) + _TOKEN.findall(path)):
            found += self.filed.get(t, ())
        return found

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        where = f"{host}/{path}"
        fits = [r for r, p in self.candidates(host, path) if p.match(where)]
        if own := [r for r in fits if not r.pattern_only]:
            best = min(own, key=lambda r: (-len(r.text), r.text))
            return best.text, best.action
        return None, "block" if fits else "allow"


def token_counts(urls: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many places of all URLs each literal of the rules occurs: one row a literal."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = urls.select(F.explode(F.split(F.lower("url"), _TOKEN_SQL)).alias("token")).where(F.col("token").isin(wanted))
    return {r["token"]: r["count"] for r in tokens.groupBy("token").count().collect()}


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: ``page_id``, host, path, rule, verdict."""
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    every = (*rules, *patterns)
    seen = token_counts(urls, every)
    index: list[Index] = []

    def run(batches):
        index.append(Index(every, seen))
        for b in batches:
            where = [parts(u) for u in b.column("url").to_pylist()]
            found = [index[-1].judge(h, p) for h, p in where]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in ([h for h, _ in where], [p for _, p in where], [r for r, _ in found], [v for _, v in found]))], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"page_id {urls.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


#: The same judgement in SQL, for the lists above.
SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, host, path, (SELECT {'t': h || q, 'a': action} FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(h || q) DESC, h || q LIMIT 1) AS best FROM p)
SELECT page_id, host, path, best.t AS rule,
  CASE WHEN best IS NOT NULL THEN best.a WHEN regexp_matches(host, '(^|[^a-z0-9])(casino|pills|xxx|free-money)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

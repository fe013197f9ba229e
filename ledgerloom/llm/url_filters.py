"""URL filters: pattern rules indexed by their rarest literal token.

A rule carries a regular expression over host, ``?`` and path (neither has a ``?`` of its own, whatever else is in a URL) and the literal tokens any match must contain. Token counts over
all URLs choose each rule's rarest token; a URL's tokens fetch its candidate rules, and only those run their expressions.
Rules are the caller's (at most MAX_RULES, checked, so their index may be sent to every task).

Defined results: a null URL, or one without ``://``, has empty host and path, matches no rule and is allowed. Equal URLs
are judged alike; the longest rule text wins, ties go to the smaller text. A column ``judged`` is replaced, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
TOKEN = re.compile(r"[0-9a-z]+")
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """label: what is reported, null for rules of the method's own; host rules come before pattern rules."""

    text: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    label: str | None
    first: int = 0  # among pattern rules that fit, the smallest decides


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits host and its subdomains, and paths that start with path. Its tokens: the host's, and the path's closed ones."""
    closed = TOKEN.findall(path.translate(LOWER).rstrip(LETTERS))
    return Rule(host + path, rf"(?:[^?]*\.)?{re.escape(host)}\?{re.escape(path)}", verdict, (*TOKEN.findall(host), *closed), host + path)


def pattern_rule(pattern: str, tokens: Iterable[str], verdict: str = "block") -> Rule:
    """The method's own rule: a pattern over host, ``?`` and path; tokens are whole [0-9a-z]+ runs that a match must hold."""
    return Rule(pattern, pattern, verdict, tuple(tokens), None)


def list_rule(line: str) -> Rule | None:
    """A rule of a public filter list (the common ``||host^path``, ``|``, ``*``, ``^``, ``@@`` syntax) over host and path; ``@@``
    exceptions come before blocking rules. None for comments, cosmetic rules, rules with options (they need the request) or a query (only host and path are judged),
    expressions, and rules without a token that every match must hold as a whole, which no index can file.
    """
    body = line.strip()
    if not body or body[0] in "![" or "##" in body or "#@#" in body or "#?#" in body:
        return None
    allow = body.startswith("@@")
    body = body[2 * allow :].lower()
    if "$" in body or "?" in body or (len(body) > 1 and body[0] == body[-1] == "/"):
        return None
    host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
    body = body.removeprefix("||" if host else "|" if start else "").removesuffix("|")
    closed = lambda at, anchored: body[at] != "*" if 0 <= at < len(body) else anchored
    tokens = [m[0] for m in TOKEN.finditer(body) if closed(m.start() - 1, start) and closed(m.end(), end)]
    if not tokens:
        return None
    parts = {"*": ".*", "^": r"(?:\??[^0-9a-z_.%?-]|\??$)", "/": r"\??/"}
    pattern = "".join(parts.get(c) or re.escape(c) for c in body)
    before = r"(?:[^?]*\.)?" if host else "" if start else ".*"
    return Rule(line.strip(), f"(?i:{before}{pattern}{r'\??' if end else ''})" + ("" if end else "(?:.*)"), "allow" if allow else "block", tuple(tokens), None, 0 if allow else 1)


#: The host rules of the contract and the method's own patterns for advertising and tracking hosts; a rule of
#: each tracking word, as tokens are whole words, and word ends are ASCII's, as in tokens and SQL.
HOST_RULES = (host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow"))
OWN_RULES = (
    pattern_rule(r"(?:[^?]*\.)?ads[-.][^?]*\?.*", ("ads",)),
    *(pattern_rule(rf"[^?]*(?a:\b{t}\b)[^?]*\?.*", (t,)) for t in ("track", "tracker", "tracking")),
    pattern_rule(r"[^?]*\?/(?:[^/]+/)*banner/.*", ("banner",)),
)


def parse(url: str | None) -> tuple[str, str]:
    """Host and path as the module's text defines them."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def url_tokens(url: str | None) -> set[str]:
    return set(TOKEN.findall((url or "").translate(LOWER)))


def rarest_tokens(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[int, str]:
    """For each rule, the token of it that fewest URLs of the whole table hold (ties: the smaller token)."""
    spark = pages.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string"))
    lowered = F.translate(F.col(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = pages.select(F.explode(F.array_distinct(F.split(lowered, "[^0-9a-z]+"))).alias("token"))
    counted = {r["token"]: r["count"] for r in tokens.join(wanted, "token", "left_semi").groupBy("token").count().collect()}
    return {i: min(r.tokens, key=lambda t: (counted.get(t, 0), t)) for i, r in enumerate(rules)}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + OWN_RULES, url: str = "url") -> DataFrame:
    """pages with ``judged``: struct(host, path, rule, verdict). No shuffle but the small count of the rules' tokens."""
    if len(rules) > MAX_RULES or any(not r.tokens for r in rules):
        raise ValueError(f"at most {MAX_RULES} rules, each with a literal token")
    index: dict[str, list[int]] = {}
    for i, token in rarest_tokens(pages, rules, url).items():
        index.setdefault(token, []).append(i)

    shared = pages.sparkSession.sparkContext.broadcast((rules, index))  # MAX_RULES bounds it
    compiled: dict[int, re.Pattern] = {}  # a task's own copy, filled as rules are met

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def apply(urls: pd.Series) -> pd.DataFrame:
        (rules, index), rows = shared.value, []
        for u in urls:
            u = u if isinstance(u, str) else None
            host, path = parse(u)
            subject, best = f"{host}?{path}", None
            for token in url_tokens(u) if host or path else ():
                for i in index.get(token, ()):
                    rule = rules[i]
                    rank = (rule.label is None, rule.first, -len(rule.text), rule.text)
                    if best is not None and best[0] <= rank:
                        continue
                    if i not in compiled:
                        compiled[i] = re.compile(rule.pattern + (r"" if rule.label is None else r".*"), re.S)
                    if compiled[i].fullmatch(subject):
                        best = (rank, rule)
            rows.append((host, path, best[1].label if best else None, best[1].verdict if best else "allow"))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.withColumn("judged", apply(F.col(url)))

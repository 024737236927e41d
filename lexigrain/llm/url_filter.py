"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that every match has. Token
frequencies are counted over all URLs (only for tokens that rules name, so the counts are as many as the
rules' tokens); each rule is filed under its rarest token. A URL's tokens fetch their candidate rules and
only those expressions run. Rules without a token, if any, run on every URL. Rules may come from a table
(``rules_of``); they are sent to each executor once, and a worker compiles an expression when a URL first
asks for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``host + path``; ``tokens`` are whole tokens of the lower-cased
    ``host + path`` that each match contains. Exact rules (host and path) take precedence, the longest
    first; of pattern rules, an allowing one wins over a blocking one."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    exact: bool = False


def place_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``. The last token of the
    path isn't one of the rule's tokens, for the URL may go on with it."""
    inner = re.sub(r"[a-zA-Z0-9]+$", "", path)
    ends = "" if path else r"(?:/|\Z)"
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + re.escape(host + path) + ends, tuple(TOKEN.findall((host + inner).lower())), True)


def word_rule(label: str, verdict: str = "block") -> Rule:
    """Fits hosts that have ``label`` as one of their labels."""
    return Rule(label, verdict, r"^(?:[^/]*\.)?" + re.escape(label) + r"(?:[./]|\Z)", tuple(TOKEN.findall(label)))


#: The production rules: places, then labels of hosts known for spam, betting, adult content or tracking.
PLACES = (place_rule("com", "/en/", "block"), place_rule("example.com", "/en/7", "allow"), place_rule("net", "/de/", "allow"), place_rule("example.net", "/de/8", "block"), place_rule("org", "/es/", "block"))
LABELS = tuple(map(word_rule, ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")))


RULES = "kind string, host string, path string, pattern string, tokens string, verdict string"


def rules_of(table: DataFrame, max_rules: int = 1_000_000) -> list[Rule]:
    """Rules from a table of RULES: of kind ``place`` (host and path), ``label`` (host, a label of hosts) or
    ``pattern`` (a regular expression over host and path, and the tokens, parted by blanks, that all its
    matches have; its name is the pattern). Nulls count as empty; other columns are ignored; repeated rules
    count once. ValueError for more than ``max_rules`` rules, which is what a driver and a worker are
    expected to hold, for another kind or verdict, and for a broken pattern."""
    rows = table.select(*(c.split()[0] for c in RULES.split(", "))).distinct().limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    out = []
    for r in rows:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"no verdict: {r.verdict!r}")
        if r.kind == "place":
            out.append(place_rule((r.host or "").translate(str.maketrans(UPPER, LOWER)), r.path or "", r.verdict))
        elif r.kind == "label":
            out.append(word_rule((r.host or "").translate(str.maketrans(UPPER, LOWER)), r.verdict))
        elif r.kind == "pattern":
            try:
                re.compile(r.pattern or "")
            except re.error as problem:
                raise ValueError(f"{r.pattern!r}: {problem}") from None
            out.append(Rule(r.pattern or "", r.verdict, r.pattern or "", tuple(TOKEN.findall((r.tokens or "").lower()))))
        else:
            raise ValueError(f"no kind of rule: {r.kind!r}")
    return sorted(out, key=lambda r: (r.name, r.verdict))


def split_urls(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both empty for null and for URLs without
    ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), after.alias("after"))
    host = F.translate(F.regexp_extract("after", "^[^/?#]*", 0), UPPER, LOWER)
    return rows.select("page_id", host.alias("host"), F.regexp_extract("after", "^[^/?#]*([^?#]*)", 1).alias("path"))


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """In how many of ``urls`` each of ``tokens`` occurs."""
    named = sorted(set(tokens))
    if not named:
        return {}
    asked = urls.sparkSession.createDataFrame([(t,) for t in named], "token string")
    found = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))).alias("token"))
    rows = found.join(F.broadcast(asked), "token").groupBy("token").agg(F.count("*").alias("n")).collect()
    return {t: 0 for t in named} | {r.token: r.n for r in rows}


class RuleIndex:
    """Rules by their rarest token. Expressions are compiled when they are first asked for."""

    def __init__(self, rules: Iterable[Rule], counts: Mapping[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        self.compiled: dict[str, re.Pattern] = {}
        rules = list(rules)
        named = Counter(t for r in rules for t in set(r.tokens))  # of tokens as rare the one that fewer rules have
        for rule in rules:
            file = self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), named[t], t)), []) if rule.tokens else self.always
            file.append(rule)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compiled": {}}

    def candidates(self, place: str) -> Iterator[tuple[Rule, re.Pattern]]:
        found = [self.by_token[token] for token in set(TOKEN.findall(place.lower())) & self.by_token.keys()]
        for rule in chain(self.always, *found):
            pattern = self.compiled.get(rule.pattern)
            if pattern is None:
                pattern = self.compiled[rule.pattern] = re.compile(rule.pattern)
            yield rule, pattern

    def judge(self, place: str, default: str) -> tuple[str | None, str]:
        """The winning place rule's name (None without one) and the verdict."""
        fit = [rule for rule, pattern in self.candidates(place) if pattern.search(place)]
        exact = max((r for r in fit if r.exact), key=lambda r: (len(r.name), r.name, r.verdict), default=None)
        if exact is not None:
            return exact.name, exact.verdict
        verdicts = {r.verdict for r in fit}
        return None, "allow" if "allow" in verdicts else "block" if verdicts else default


def judge_urls(df: DataFrame, rules: Iterable[Rule] = (*PLACES, *LABELS), id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    ``rule`` is the longest fitting place rule, whose verdict holds; else the pattern rules decide, and
    ``default`` where none fits. Null urls and those without ``://`` have an empty host and path and get
    ``default`` (unless a rule without tokens fits them); rows repeated with one identifier are judged
    each; other columns and their names don't matter; an empty table gives no rows. A URL of any length is
    judged whole.
    """
    rules = list(rules)
    urls = split_urls(df, id_col, url_col)
    index = df.sparkSession.sparkContext.broadcast(RuleIndex(rules, token_counts(urls, (t for r in rules for t in r.tokens))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = index.value.judge
        for batch in batches:
            found = [judge(h + p, default) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")

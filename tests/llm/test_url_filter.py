import re

import pytest

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.llm.queries import URLS, op4_url_filter
from lexigrain.llm.url_filter import LABELS, PLACES, RULES, Rule, RuleIndex, judge_urls, place_rule, rules_of


def test_against_sql(spark):
    assert of_spark(op4_url_filter(spark, SF)) == of_duckdb(database(SF), URLS)


URLS_AND_VERDICTS = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("http://A.B.Example.COM/en/71?x", "a.b.example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://example.com/en/8#f", "example.com", "/en/8", "com/en/", "block"),
    ("x://xexample.com/en/7", "xexample.com", "/en/7", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://example.net/de/8/9", "example.net", "/de/8/9", "example.net/de/8", "block"),
    ("http://spam-farm.example.net/de/", "spam-farm.example.net", "/de/", "net/de/", "allow"),
    ("http://www.spam-farm.example.net/fr/", "www.spam-farm.example.net", "/fr/", None, "block"),
    ("http://xspam-farm.net/", "xspam-farm.net", "/", None, "allow"),
    ("http://org?/es/", "org", "", None, "allow"),
    ("http://a://b.org/es/", "a:", "//b.org/es/", None, "allow"),
    ("http://É.ORG/es/é\n", "É.org", "/es/é\n", "org/es/", "block"),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, u, "x") for k, (u, *_) in enumerate(URLS_AND_VERDICTS)], "page_id long, url string, host string")
    assert [tuple(r)[1:] for r in sorted(judge_urls(df).collect())] == [w[1:] for w in URLS_AND_VERDICTS]
    assert judge_urls(df.limit(0)).collect() == []


def test_index_runs_only_candidates():
    index = RuleIndex([*PLACES, *LABELS], {"com": 90, "en": 80, "example": 99, "net": 50, "de": 40, "org": 9, "es": 10})
    assert set(index.by_token) >= {"en", "de", "org"}
    assert [r.name for r, _ in index.candidates("a.org/fr/1")] == ["org/es/"]
    assert list(index.candidates("a.info/1")) == []


@pytest.mark.parametrize("place", ["a.com/en/7x", "example.com/en/7", "b.example.net/de/80", "org/es/", "x.adult-x.net/", "example.net/de/"])
def test_index_and_plain_loop_agree(place):
    rules = [*PLACES, *LABELS, Rule("any", "block", "zz$", ())]
    index = RuleIndex(rules, {})
    exact = max((r for r in rules if r.exact and re.search(r.pattern, place)), key=lambda r: len(r.name), default=None)
    other = {r.verdict for r in rules if not r.exact and re.search(r.pattern, place)}
    want = (exact.name, exact.verdict) if exact else (None, "block" if "block" in other else "allow")
    assert index.judge(place, "allow") == want


def test_host_rule():
    whole = re.compile(place_rule("a.org", "", "block").pattern)
    assert [bool(whole.search(p)) for p in ("a.org", "b.a.org/x", "a.orgx", "xa.org")] == [True, True, False, False]


def test_many_rules_from_a_table(spark):
    """Ten thousand rules: few run on a URL, and the verdicts are those of trying all."""
    table = [("place", f"site{k}.org", f"/part{k % 7}/", None, None, "block" if k % 3 else "allow") for k in range(8_000)]
    table += [("label", f"label{k}", None, None, None, "block") for k in range(1_000)]
    table += [("pattern", None, None, rf"/item{k}/[0-9]+$", f"item{k}", "block" if k % 2 else "allow") for k in range(1_000)]
    rules = rules_of(spark.createDataFrame([(*r, 1) for r in [*table, table[0]]], RULES + ", url int"))
    assert len(rules) == 10_000
    urls = [f"http://{'www.' * (k % 2)}site{k * 37 % 9_000}.org/part{k % 9}/item{k}/{k}" for k in range(60)]
    urls += [f"http://a.label{k}.com/item{k}/1{'x' * (k % 2)}" for k in range(40)] + ["http://site1.org/part1/" + "long/" * 40_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    index, compiled = RuleIndex(rules, {}), [(r, re.compile(r.pattern)) for r in rules]
    for k, url in enumerate(urls):
        place = url.split("://")[1]
        assert len(list(index.candidates(place))) <= 4
        fit = [r for r, pattern in compiled if pattern.search(place)]
        exact = max((r for r in fit if r.exact), key=lambda r: len(r.name), default=None)
        verdicts = {r.verdict for r in fit}
        assert got[k] == ((exact.name, exact.verdict) if exact else (None, "block" if verdicts == {"block"} else "allow")), url[:80]
    assert len(index.compiled) < 200


def test_broken_rules(spark):
    make = lambda *rows: rules_of(spark.createDataFrame(rows, RULES), max_rules=1)
    assert make(("place", "A.org", None, None, None, "block"))[0] == place_rule("a.org", "", "block")
    for rows in ([("place", "a", "", None, None, "no")], [("x", "a", "", None, None, "block")], [("pattern", None, None, "(", None, "block")], [("label", "a", None, None, None, "block"), ("label", "b", None, None, None, "block")]):
        with pytest.raises(ValueError):
            make(*rows)

import random
from collections import defaultdict

import pytest

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.llm.mixing import DOMAINS, LANGS, mix, select_mixture
from lexigrain.llm.queries import MIXING, op6_mixing
from pyspark.sql import functions as F


def test_against_sql(spark):
    assert of_spark(op6_mixing(spark, SF)) == of_duckdb(database(SF), MIXING)


def divide(budget, children):
    """{name: share} of (name, weight, cap), by filling one child after another."""
    shares, left, open_ = {}, budget, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    weight = sum(c[1] for c in open_)
    while open_ and open_[0][2] * weight <= left * open_[0][1]:
        name, w, cap = open_.pop(0)
        shares[name], left, weight = cap, left - cap, weight - w
    return shares | {name: max(left, 0) * w // weight for name, w, _ in open_}


def test_budgets_by_hand(spark):
    rng = random.Random(11)
    rows = [(k, "w " * rng.randrange(0, 60), rng.choice(["en", "de", "xx", None]), rng.choice(["src1", "src2", "src8", "src15", "odd", None])) for k in range(400)]
    rows += [(1000 + k, "hot " * 50, "en", "src0") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(df).collect()
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in got:
        tree[r.domain][r.lang][r.source] += r.tokens
    total = sum(r.tokens for r in got)
    cap = lambda node: 4 * node if isinstance(node, int) else sum(map(cap, node.values()))
    want = {}
    for domain, d_share in divide(total, [(d, DOMAINS.get(d, 1), cap(n)) for d, n in tree.items()]).items():
        for lang, l_share in divide(d_share, [(x, LANGS.get(x, 1), cap(n)) for x, n in tree[domain].items()]).items():
            for source, share in divide(l_share, [(s, 1, cap(n)) for s, n in tree[domain][lang].items()]).items():
                want[domain, lang, source] = share
    assert {(r.domain, r.lang, r.source): r.leaf_budget for r in got} == want
    used = defaultdict(int)
    longest = max(r.tokens for r in got)
    for r in got:
        used[r.domain, r.lang, r.source] += r.tokens * r.times
    for leaf, budget in want.items():
        assert budget - longest <= used[leaf] <= budget or tree[leaf[0]][leaf[1]][leaf[2]] * 4 == used[leaf]
    assert sorted(map(tuple, mix(df.repartition(9)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_selection_and_edges(spark):
    df = spark.createDataFrame([(k, t, "en", "src1", 7) for k, t in enumerate(["a b", None, "", "c " * 9, "c " * 9])] + [(None, "x", None, None, 7)], "doc_id long, text string, lang string, source string, tokens int")
    half = select_mixture(df, budget=F.expr("sum(leaf_tokens) div 2"))
    assert half.columns == df.columns and 0 < half.count() < 6
    assert select_mixture(df).count() == 6
    assert mix(df.limit(0)).collect() == []
    assert mix(df).count() == 6


@pytest.mark.parametrize("plan_of", [mix, select_mixture])
def test_native(spark, plan_of):
    df = spark.createDataFrame([(1, "a", "en", "src1")], "doc_id long, text string, lang string, source string")
    assert "Python" not in plan_of(df)._jdf.queryExecution().executedPlan().toString()


def test_bucket_sizes_change_nothing(spark):
    """Buckets cut once and several times, a hot leaf, a very long text and clashing columns."""
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 9), "en", rng.choice(["src0", "src0", "src8"]), "x", 5) for k in range(900)] + [(5_000, "long " * 100_000, "en", "src0", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, times int")
    budget = F.expr("sum(leaf_tokens) div 3")
    want = sorted(map(tuple, mix(df, budget=budget).collect()))
    for size in (1, 10):
        assert sorted(map(tuple, mix(df, budget=budget, bucket_rows=size).collect())) == want


def test_names_that_clash(spark):
    rows = [(k, "a b c", "en", "src1", 1, 2, 3) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, times int, _times int, __used int")
    got = select_mixture(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(rows)

import math
import random

import pytest

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.llm import queries
from lexigrain.llm.hard_negatives import mine
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, score double, anchor string"


def test_against_sql(spark):
    assert of_spark(queries.op11_hard_negatives(spark, SF)) == of_duckdb(database(SF), queries.oracle_sql()["op11_hard_negatives"])


def brute(rows, anchor=lambda i: i % 100 == 0, k=5, m=5, low=80, scale=256):
    """All pairs, in whole numbers."""
    found = {}
    for i, v, label, *_ in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            found[i, label, tuple(math.floor(scale * x) for x in v)] = None
    rows, last = list(found), 1 << 63
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[1], last if r[0] is None else r[0])
    out = []
    for a, own, v in rows:
        if a is None or not anchor(a):
            continue
        same = sorted(((i, dot(v, w)) for i, label, w in rows if label == own and i != a), key=order)[:k]
        others = sorted(((i, dot(v, w)) for i, label, w in rows if label != own), key=order)
        for p, ps in same:
            for rank, (n, ns) in enumerate([x for x in others if low * ps <= 100 * x[1] <= 100 * ps][:m], 1):
                out.append((a, p, rank, n, ps, ns))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"rows_per_list": 20, "block_rows": 9, "chunk_anchors": 2}, {"rows_per_list": 10, "max_fit_rows": 40, "block_rows": 1_000}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(600):
        c = rng.choice(middles)
        rows.append((i, [x + rng.gauss(0, 0.1) for x in c], rng.choice([0, 0, 0, 1, 2]), 1.0, "clash"))
    common = [0.5, 0.25, -0.5, 0.0, 1.0, 0.75]
    rows += [(1_000 + i, common, i % 3, 1.0, "clash") for i in range(200)]  # one vector in a quarter of the rows
    rows += rows[:30] + [(None, common, 1, 0.0, ""), (300, None, 1, 0.0, ""), (400, [1.0, None], 1, 0.0, ""), (500, [1.0, float("nan")], 1, 0.0, ""), (700, [float("inf")], 1, 0.0, ""), (800, common, None, 0.0, ""), (900, [], 2, 0.0, ""), (2_000, [1.0], 2, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(mine(df, **options)) == brute(rows)


def test_options(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3), 0.0, "") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mine(df, is_anchor=F.col("vec_id") < 6, positives=2, negatives=3, low_percent=50, scale=10, rows_per_list=15)
    assert rows_of(got) == brute(rows, lambda i: i < 6, 2, 3, 50, 10)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty).collect() == [] and mine(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mine(spark.createDataFrame([(1, [1.0], 0, 0.0, ""), (2, [1.0], 1, 0.0, "")], SCHEMA)).collect() == []  # no anchor
    assert mine(spark.createDataFrame([(0, [], 0, 0.0, ""), (1, [], 0, 0.0, ""), (2, [], 1, 0.0, "")], SCHEMA)).collect() == [(0, 1, 1, 2, 0, 0)]

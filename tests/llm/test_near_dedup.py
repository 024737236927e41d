import random
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF
from lexigrain.llm.near_dedup import WordHashes, bands_of, block_links, components, drop_near_copies, group_links, near_dedup, outlier_links, prefix_lists, shingle_set, shingles, sketch, words_of
from lexigrain.llm.queries import op8_near_dedup
from pyspark.sql import functions as F


def plain(rows, size, percent=80):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {i: shingle_set((t or "").encode(), size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(i)
    return {i: (len(sets[i]), min(g)) for g in groups.values() for i in g}


def got(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(df, **options).collect()}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = op8_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def variants(rng, n, words=60, changes=7):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes)):
            text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_groups_with_outliers(spark, size):
    """Large groups around one text, in which many texts aren't linked to the least, and chains."""
    rng = random.Random(size)
    texts = variants(rng, 250) + variants(rng, 40, 30, 4) + variants(rng, 3) + [None, "", "  \n", "one", "ONE", "one two", "One two", "x" * 70_000] * 2
    words = [f"c{k}" for k in range(200)]
    texts += [" ".join(words[k : k + 100]) for k in range(0, 100, 5)]  # each is linked with its neighbours only
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, bucket int, hub int").repartition(6)
    assert got(df, shingle_words=size) == plain(rows, size)
    kept = drop_near_copies(df, shingle_words=size)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in plain(rows, size).items() if i == c}


def test_outlier_search_in_blocks(spark):
    rng = random.Random(9)
    rows = list(enumerate(variants(rng, 120, 40, 6)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    placed = spark.createDataFrame([(0, i, i) for i, _ in rows], "hub long, doc_id long, component long")
    want = {c for _, c in plain(rows, 2).values()}
    for block in (7, 1_000):
        found = outlier_links(placed, texts, 2, 80, block)
        joined = {r.node: r.component for r in components(found).collect()}
        assert {joined.get(i, i) for i, _ in rows} == want


def test_block_links():
    rows = [(False, 1, 1, b"a b c d e f g h i j"), (False, 2, 2, b"a b"), (False, 3, 9, b"a b c d e f g h i j"), (True, 4, 4, b"a b c d e f g h i j k"), (True, 3, 9, b"a b c d e f g h i j")]
    assert block_links(rows, 2, 80, WordHashes()) == {(4, 1), (4, 9), (9, 1)}
    assert block_links(rows[3:], 2, 80, WordHashes()) == set()


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: c for n, c in root.items() if n != c}


def test_sketch():
    rng = np.random.default_rng(0)
    close = []
    for similarity in (0.5, 0.8):
        both = int(400 * similarity * 2 / (1 + similarity))
        a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
        b = np.unique(np.concatenate([a[:both], rng.integers(0, 2**63, 400 - both).astype(np.uint64)]))
        close.append((sketch(a, 2_000) == sketch(b, 2_000)).mean())
    assert abs(close[0] - 0.5) < 0.06 and abs(close[1] - 0.8) < 0.05
    one = sketch(np.array([7], np.uint64), 150)
    assert len(one) == 150 and (one != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and len(bands_of(one, 30)) == 30


def test_words_and_edges(spark):
    assert words_of("A\x0bÉ b\x1fC d".encode()) == ["a".encode(), "É b\x1fc".encode(), b"d"]
    assert len(shingles([b"a"], 5, WordHashes(1))) == 1 and len(shingles([], 5, WordHashes())) == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup(df).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_dedup(df.limit(0)).collect() == []


def templates(n, shared=100, own=50):
    """Texts that share a template of half their words, each with as many words of its own; similarity 0.5."""
    common = " ".join(f"t{k}" for k in range(shared))
    return [(i, common + " " + " ".join(f"o{i}x{k}" for k in range(own))) for i in range(n)]


def test_members_of_a_template_are_not_compared(spark):
    """Five thousand members of one hub at similarity 0.5: what their prefixes have in common doesn't grow
    with their pairs, and the few links among them are found."""
    rows = templates(5_000)
    rows += [(5_000 + k, rows[k][1] + f" more{k}") for k in range(0, 40, 2)]  # near copies of some
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    members = texts.withColumn("component", F.col("doc_id"))
    lists = prefix_lists(members, 2, 80)
    assert lists.count() < 5_000
    placed = members.select(F.lit(0).cast("long").alias("hub"), "doc_id", "component")
    found = {(r.a, r.b) for r in group_links(placed, texts, 2, 80).collect()}
    assert found == {(k, 5_000 + k) for k in range(0, 40, 2)}
    assert group_links(placed.where("doc_id = 1"), texts, 2, 80) is None


@pytest.mark.parametrize("short", [2, 32])
def test_prefixes_lose_no_link(spark, short):
    rng = random.Random(12)
    rows = list(enumerate(variants(rng, 90, 40, 9) + variants(rng, 60, 25, 5)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    placed = spark.createDataFrame([(0, i, i) for i, _ in rows], "hub long, doc_id long, component long")
    joined = {r.node: r.component for r in components(group_links(placed, texts, 2, 80, short)).collect()}
    assert {i: joined.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in plain(rows, 2).items()}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 5, 6)], "doc_id long, text string, __dropped int, DROPPED int")
    assert [tuple(r) for r in drop_near_copies(df).collect()] == [(1, "a b c d e f", 5, 6)]

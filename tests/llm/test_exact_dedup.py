import hashlib
import random
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.llm.exact_dedup import PatriciaTrie, drop_copies, exact_dedup, shared_prefix


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99)), max_size=40), st.integers(1, 40), st.booleans())
def test_trie(rows, budget, largest):
    trie, want = PatriciaTrie(largest, budget), defaultdict(list)
    for key, ident in rows:
        trie.insert(key, ident, 1, [ident])
        want[key].append(ident)
    pick = max if largest else min
    got = sorted((owner, count, sorted(refs)) for owner, count, refs in trie.groups())
    assert got == sorted((pick(v), len(v), sorted(v)) for v in want.values())


def test_shared_prefix():
    assert [shared_prefix(a, b) for a, b in ((b"", b"a"), (b"abc", b"abd"), (b"ab", b"abc"), (b"x", b"y"))] == [0, 2, 2, 0]


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a ", "é", "x" * 300_000, "x" * 300_000 + "y"]
    rows = [(k, rng.choice(texts), "s", -k) for k in range(400)] + [(5, "a", "s", 0), (None, "a", "s", 1), (None, "alone", "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ref string, body long").repartition(7)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = []
    for i, t, *_ in rows:
        group = groups[t or ""]
        owner = max((x for x in group if x is not None), default=None)
        want.append((i, owner, len(group), i == owner, hashlib.sha256((t or "").encode()).hexdigest()))
    for budget in (1 << 28, 1_000):
        got = [tuple(r)[:5] for r in exact_dedup(df, max_trie_bytes=budget).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert drop_copies(df).columns == df.columns
    assert sorted(r.doc_id or -1 for r in drop_copies(df).collect()) == sorted(i or -1 for i, *_, kept, _ in want if kept)
    least = exact_dedup(df.where("doc_id is not null"), keep_largest=False)
    assert {(r.group_size, r.keep_id) for r in least.collect()} == {(len([x for x in g if x is not None]), min(x for x in g if x is not None)) for g in groups.values() if g != [None]}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(empty).collect() == [] and drop_copies(empty).collect() == []


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a", 5, 6, 7)], "doc_id long, text string, __dropped int, Dropped int, sha256 int")
    assert [tuple(r) for r in drop_copies(df).collect()] == [(2, "a", 5, 6, 7)] and drop_copies(df).columns == df.columns


def test_many_references_take_linear_time():
    def seconds(n):
        trie, began = PatriciaTrie(), time.process_time()
        for k in range(n):
            trie.insert(b"one text", k, 1, [k])
        assert [(owner, count, list(refs)) for owner, count, refs in trie.groups()] == [(n - 1, n, list(range(n)))]
        return time.process_time() - began

    assert seconds(80_000) < 8 * max(seconds(20_000), 0.1)


def test_references_are_spilled():
    """One string with more references than fit, among others."""
    trie = PatriciaTrie(max_bytes=2_000)
    for k in range(5_000):
        trie.insert(b"common", k, 1, [k])
        trie.insert(b"c%d" % (k % 50), k, 1, [-k])
    found = {}
    for owner, count, refs in trie.groups():
        found.setdefault((owner, count), []).extend(refs)
    assert sorted(found.pop((4_999, 5_000))) == list(range(5_000))
    assert sorted((k, len(r)) for k, r in found.items()) == [((4_950 + k, 100), 100) for k in range(50)]

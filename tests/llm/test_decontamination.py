import hashlib
import random
import re
from string import ascii_lowercase, ascii_uppercase

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.llm import queries
from lexigrain.llm.common import keep
from lexigrain.llm.decontamination import benchmark_items, build_index, decontaminate, phrases, proximity, vocabulary, windows_of

DOCS = "doc_id long, text string, term string, pos int, doc long"
ITEMS = "item_id long, text string, item string, win long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_against_sql(spark):
    assert of_spark(queries.op12_decontamination(spark, SF)) == of_duckdb(database(SF), queries.oracle_sql()["op12_decontamination"])


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def brute(docs, items, length=10):
    windows = [(i, w[s : s + min(length, len(w))]) for i, text, *_ in items if (w := words(text)) for s in range(max(1, len(w) - length + 1))]
    out = []
    for d, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for i, w in windows:
            for s in range(len(own) - len(w) + 1):
                if own[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["the", "The", "a", "a", "Éa", "éa", "b2", "x", "wörd", "long", "rare1", "rare2", "𝒳y"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 10, 14, 25])), "clash", 1) for i in range(25)]
    items += items[:5] + [(100, items[3][1], "", 1), (101, None, "", 1), (102, "--", "", 1), (None, "unnamed item", "", 1), (7, "another text of seven", "", 1)]
    docs = [(d, text(rng.choice([0, 1, 5, 60, 200])) + rng.choice([*items, (0, "")])[1 : 2][0].__str__() + text(20), "clash", 1, 1) for d in range(60)]
    docs += docs[:5] + [(200, None, "", 1, 1), (201, "", "", 1, 1), (None, items[24][1], "", 1, 1), (202, "an unnamed ITEM here " + "pad " * 30_000, "", 1, 1), (203, "the " * 500, "", 1, 1)]
    got = decontaminate(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert rows_of(got) == brute(docs, items)
    short = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), length=3)
    assert rows_of(short) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 1, 1)], DOCS), spark.createDataFrame([(1, "a", "", 1)], ITEMS)
    assert decontaminate(docs.limit(0), items).collect() == []
    assert rows_of(decontaminate(docs, items.limit(0))) == brute([(1, "a b")], [])


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("lexigrain.llm.decontamination.MOST", 0)
    docs = [(d, f"one two three {d} four five", "", 1, 1) for d in range(30)]
    items = [(1, "Two, three 7 four", "", 1), (2, "five", "", 1), (3, "one two", "", 1), (4, "absent", "", 1)]
    assert rows_of(decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_proximity(spark):
    rng = random.Random(4)
    docs = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 30, 80]))), "", 1, 1) for d in range(25)]
    items = [(1, "a b c", "", 1), (2, "h a a g", "", 1), (3, "d", "", 1), (4, "a z", "", 1)]
    rows = keep(benchmark_items(spark.createDataFrame(items, ITEMS)))
    terms = vocabulary(rows)
    postings = build_index(spark.createDataFrame(docs, DOCS), terms)
    windows = windows_of(rows, terms, postings)
    heads = {r.doc: r.doc_id for r in postings.where("term = -1").collect()}
    text = {r.win: frozenset(w for i in items if hashlib.sha256(" ".join(words(i[1])).encode()).hexdigest() == r.item for w in words(i[1])) for r in windows.collect()}
    count = {w: sum(words(d[1]).count(w) for d in docs) for w in "abcdefghz"}
    within, want = 5, set()
    for found in text.values():
        rarest = {min(count[w] for w in found)}
        for d, t, *_ in docs:
            own = words(t)
            for p, w in enumerate(own, 1):
                starts = [s for s in range(p - within + 1, p + 1) if found <= set(own[max(s, 1) - 1 : s + within - 1])]
                if w in found and {count[w]} == rarest and starts:
                    want.add((found, d, p, starts[0]))
    got = {(text[r.win], heads[r.doc], r.pos, r.start) for r in proximity(postings, windows, within).collect()}
    assert got == want and got
    assert {(text[r.win], heads[r.doc]) for r in phrases(postings, windows).collect()} <= {(f, d) for f, d, *_ in got}

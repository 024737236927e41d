import json
import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexigrain.llm.toxicity import toxicity
from test_near_dedup import plain


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into each stage and come out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in toxicity(stages[0], labels).collect() if r.predicted == 0}
    assert set(texts(stages[1])) == clean and len(clean) < stages[0].count()


def test_exact(stages):
    owners = defaultdict(list)
    for i, t in texts(stages[1]).items():
        owners[t].append(i)
    assert set(texts(stages[2])) == set(map(max, owners.values()))


def divided(budget, children):
    """Shares of (name, weight, cap), as water fills vessels."""
    shares, left, open_ = {}, budget, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while open_ and open_[0][2] * sum(w for _, w, _ in open_) <= left * open_[0][1]:
        name, _, cap = open_.pop(0)
        shares[name] = cap
        left -= cap
    total = sum(w for _, w, _ in open_)
    return shares | {name: left * w // total for name, w, _ in open_}


def plain_mixture(rows, epochs=4):
    """Times of each document: shares down the tree, whole epochs, and a prefix of one more by seeded order."""
    leaves = defaultdict(dict)
    for r in rows:
        source = r.source or "unknown"
        k = int(source[3:]) if source[:3] == "src" and source[3:].isdigit() else None
        domain = "other" if k is None else "web" if k < 7 else "reference" if k < 14 else "community"
        leaves[domain, r.lang or "unknown", source][r.doc_id] = len([w for w in (r.text or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w])
    tokens = {leaf: sum(d.values()) for leaf, d in leaves.items()}
    cap = lambda *head: epochs * sum(n for leaf, n in tokens.items() if leaf[: len(head)] == head)
    times = {}
    by_domain = divided(sum(tokens.values()), [(d, {"web": 5, "reference": 3, "community": 2}.get(d, 1), cap(d)) for d in {x[0] for x in leaves}])
    for domain, for_domain in by_domain.items():
        langs = divided(for_domain, [(g, {"en": 4, "de": 2, "fr": 2, "es": 2}.get(g, 1), cap(domain, g)) for g in {x[1] for x in leaves if x[0] == domain}])
        for lang, for_lang in langs.items():
            for source, share in divided(for_lang, [(x[2], 1, cap(*x)) for x in leaves if x[:2] == (domain, lang)]).items():
                docs, n = leaves[domain, lang, source], tokens[domain, lang, source]
                whole = min(epochs, share // n)
                order = sorted(docs, key=lambda i, whole=whole: hashlib.md5(f"17:{whole}:{i}".encode()).hexdigest())
                upto = 0
                for i in order:
                    upto += docs[i]
                    times[i] = whole + (whole < epochs and upto <= share - whole * n)
    return times


def test_near(stages):
    found = plain(list(texts(stages[2]).items()), 5)
    assert set(texts(stages[3])) == {i for i, (_, c) in found.items() if i == c}


def test_mixing_and_packing(stages):
    before, rows = texts(stages[3]), stages[4].collect()
    times = Counter(r.doc_id for r in rows)
    assert {i: n for i, n in times.items() if n} == {i: n for i, n in plain_mixture(stages[3].collect()).items() if n}
    assert set(times) < set(before) and max(times.values()) <= 4 and max(times.values()) > 1
    assert stages[5].where("start = 0").count() == len(rows)
    once = {i: t for i, t in texts(stages[4]).items() if times[i] == 1}
    pieces = Counter((r.doc_id, r.start) for r in stages[5].collect())
    assert all(n == times[i] for (i, start), n in pieces.items() if start == 0) and once


def test_run_is_the_stages(spark, stages):
    rows = lambda df: sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])


def apply(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF))
    return out


ODD = "doc_id long, text string, lang string, source string, n_chars long, component_id string, tokens int, kept int"


def test_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and columns named like the operators' own."""
    words = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(8)]
    rows = [(k, w, "en", "src1", len(w)) for k, w in enumerate(words)]
    rows += [(0, words[0], "en", "src1", 1), (20, words[1], None, None, None), (21, words[1] + " more", "de", "src9", 1)]
    rows += [(30, None, "en", "src1", None), (31, "", None, "src1", 0), (32, " \n", "xx", None, 2), (33, "z" * 300_000, "en", "odd", 1), (None, words[2] + " and so on", "en", "src1", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "c", 1, 0) for r in rows], ODD)
    stages = apply(spark, docs)
    assert all(df.columns == docs.columns for df in stages[:-1])
    ids = lambda df: sorted((-1 if r.doc_id is None else r.doc_id) for r in df.collect())
    assert ids(stages[1]) == ids(docs)
    assert ids(stages[2]) == [-1, 0, 0, 2, 3, 4, 5, 6, 7, 20, 21, 31, 32, 33]  # repeated rows stay together
    assert ids(stages[3]) == [-1, 0, 0, 2, 3, 4, 5, 6, 7, 20, 31, 32, 33]
    assert set(ids(stages[4])) <= set(ids(stages[3])) and stages[4].count() > 0
    texts_left = [r.text for r in stages[4].collect()]
    assert stages[5].where("start = 0").count() == len(texts_left)


def test_empty_table(spark):
    assert all(df.count() == 0 for df in apply(spark, spark.createDataFrame([], ODD)))


def test_only_results_stay(spark):
    from lexigrain.llm.common import made

    before = set(made)
    corpus_pipeline.run(spark, SF).count()
    assert len(set(made) - before) < 8  # the mixture and the tables of the last stage

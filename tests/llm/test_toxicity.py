import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexigrain.llm.queries import op10_toxicity
from lexigrain.llm.toxicity import ToxicityModel, chosen, dependencies, drop_toxic, fit, form_of, generative, label_model, linear, score, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hits, misses, false = held.count((1, 1)), held.count((0, 1)), held.count((1, 0))
    assert hits / (hits + misses) > 0.9 and hits / (hits + false) > 0.9


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(6_000) < 0.2
    voters = [np.where(truth, rng.random(6_000) < 0.7, rng.random(6_000) < 0.03) for _ in range(5)]
    noise = rng.random(6_000) < 0.3
    marks = np.where(rng.random(6_000) < 0.05, ~truth, truth)
    posterior, rates = label_model(np.column_stack([*voters, voters[0], noise]), marks)  # one voter twice
    assert np.abs(rates[:6, 1] - 0.7).max() < 0.1 and rates[:6, 0].max() < 0.08
    assert abs(rates[6, 1] - rates[6, 0]) < 0.1
    assert ((posterior > 0.5) == truth).mean() > (marks == truth).mean()


def test_linear():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2_000, 3))
    y = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] + 0.5)))
    w, b = linear(x, y, l2=1e-3)
    assert np.allclose(w, [2, -1, 0], atol=0.05) and abs(b - 0.5) < 0.05


def made(spark, n=600):
    rng = random.Random(8)
    plain = [f"word{k}" for k in range(80)]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        words = rng.choices(plain, k=40) + (["badword", "worseword"] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(toxic), "clash"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    return df.select("doc_id", "text", "score"), df.select("doc_id", "toxic"), rows


def test_drops_toxic_and_keeps_the_rest(spark):
    docs, labels, rows = made(spark)
    more = spark.createDataFrame([(None, "badword worseword word1 word2 badword", "n"), (None, "word1 word2", "n"), (5000, None, "n"), (5001, "", "n"), (5002, "x" * 400_000, "n")], docs.schema)
    kept = drop_toxic(docs.unionByName(more), labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _, toxic, _ in rows if not toxic} | {None, 5000, 5001, 5002}
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["word1 word2"]


def test_bounded_sample_and_labels_stay_out(spark):
    docs, labels, _ = made(spark)
    model = fit(docs, labels, max_fit_rows=200)
    assert "badword" in model.terms and len(model.weights) == len(model.terms) + 7
    first = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert first == {r.doc_id: r.score for r in score(docs.repartition(3), model).collect()}


def test_edges(spark):
    docs, labels, _ = made(spark, 20)
    one_class = labels.where("toxic = 0")
    assert len({r.score for r in toxicity(docs, one_class).collect()}) == 1
    assert toxicity(docs.limit(0), labels).collect() == []
    assert toxicity(docs, labels.limit(0)).count() == 20
    nothing = {r.doc_id: r.score for r in score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), ToxicityModel({}, [0.0] * 7, -1.0)).collect()}
    assert nothing[1] == nothing[2]


def test_bound_counts_spellings_only(spark):
    docs, labels, rows = made(spark)
    rare = F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit(" zorkig"))).otherwise(F.col("text"))
    found = fit(docs.withColumn("text", rare), labels, max_terms=5).terms
    assert len(found) == 5 and {"badwo*", "worse*", "zorki*"} <= set(found)
    assert set(fit(docs.withColumn("text", rare), labels, max_terms=1).terms) == {"badwo*", "worse*", "zorki*"}
    assert chosen(["abcdef*", "abcde*", "abcdefg", "xy", "abcd"], 3) == ["abcde*", "xy", "abcd"]


def plain_score(text, model):
    """The classifier's score by counting the terms one by one."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    scale = 1000 / max(20, len(words))
    fits = lambda w, t: len(w) > len(t) - 1 and w.startswith(t[:-1]) if t.endswith("*") else w == t
    z = model.bias + sum(model.weights[c] * math.log1p(scale * sum(fits(w, t) for w in words)) / 4 for t, c in model.terms.items())
    z += model.weights[len(model.terms)] * math.log1p(scale * sum(any(fits(w, t) for t in model.terms) for w in words))
    z += sum(a * b for a, b in zip(model.weights[len(model.terms) + 1 :], form_of(text or "", words, Counter(words)), strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_of_repeated_rows_by_hand(spark):
    docs, labels, _ = made(spark)
    model = fit(docs, labels)
    rows = [(1, "Badword, badword WORSEWORDS! word1"), (1, "Badword, badword WORSEWORDS! word1"), (1, "word2 word3"), (None, "badwo"), (2, None)]
    found = score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, round(r.score, 9)) for r in found) == sorted((i or 0, round(plain_score(t, model), 9)) for i, t in rows)


def test_dependencies_are_the_dependent_pairs():
    rng = np.random.default_rng(3)
    truth = rng.random(5_000) < 0.3
    base = [np.where(truth, rng.random(5_000) < 0.6, rng.random(5_000) < 0.1) for _ in range(4)]
    near = np.where(rng.random(5_000) < 0.05, ~base[2], base[2])
    votes = np.column_stack([*base, near]).astype(np.uint8)
    parent, left = dependencies(truth.astype(float), votes)
    assert {frozenset((k, p)) for k, p in enumerate(parent) if p >= 0} == {frozenset((2, 4))} and 0.8 < left < 1
    assert dependencies(truth.astype(float), votes[:, :0])[0].size == 0
    _, _, held, given = generative(votes, truth.astype(int))
    assert given.shape == (6, 2, 2) and held[-1] == -1

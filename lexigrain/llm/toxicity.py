"""Toxicity by weak supervision.

Fitting, on a bounded sample of labelled rows (``max_fit_rows``): words and word beginnings that stand
out in rows marked toxic make a lexicon; each of its terms, and a few patterns of the text's form, is a
voter. A generative label model estimates each voter's rate of voting in either class by EM, with the
given mark as one more, fallible voter. Votes that are correlated within a class are parameters of it: a
voter's rates are conditional on the class and on the voter that tells most about it, by a maximum spanning
tree of the conditional mutual information. A linear classifier is then fitted to the model's posterior
labels on the rates of the same terms. Scoring is one pass over all texts with the classifier's few hundred
weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import Memo, discard, id_and_text, keep, lean

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that count as terms, by length.
STARTS = (5, 6, 7, 8)
PATTERNS = ("shout", "exclaim", "repeat", "symbols", "links", "digits")


def terms_of(word: str) -> list[str]:
    """The word itself and its proper beginnings, marked with a star."""
    return [word, *(word[:k] + "*" for k in STARTS if k < len(word))]


def form_of(text: str, words: list[str], counts: Counter) -> list[float]:
    """Values of the form patterns, each 0 to 1."""
    n, w = max(1, len(text)), max(1, len(words))
    letters = max(1, sum(map(len, words)))
    return [
        sum(map(str.isupper, text)) / letters,
        min(1.0, 10 * text.count("!") / w),
        max(counts.values(), default=0) / w if w >= 5 else 0.0,
        1 - min(1.0, letters / n),
        min(1.0, 10 * text.count("://") / w),
        sum(map(str.isdigit, text)) / n,
    ]


@dataclass
class ToxicityModel:
    """Weights of the classifier: ``terms`` maps a term to its column; the last columns are the share of
    lexicon words and the form patterns. Of the label model: ``accuracies``, each voter's rates of voting in
    classes 0 and 1; ``correlations``, for a voter and the one it depends on, its rates in class 0 and 1
    where that one doesn't vote and where it does (0 without, 0 with, 1 without, 1 with)."""

    terms: dict[str, int]
    weights: list[float]
    bias: float
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlations: dict[tuple[str, str], tuple[float, ...]] = field(default_factory=dict)


def columns_of(terms: Mapping[str, int]) -> Memo[str, tuple[int, ...]]:
    """The columns of a word's terms, kept for the words of a task."""
    return Memo(lambda word: tuple(terms[t] for t in terms_of(word) if t in terms), 500_000)


def rates(text: str, n_terms: int, columns: Mapping[str, tuple[int, ...]]) -> np.ndarray:
    """The classifier's inputs: log rates a thousand words of every term, of any term, and the form."""
    words = WORD.findall(text.lower())
    counts, out, hit = Counter(words), np.zeros(n_terms + 1 + len(PATTERNS)), 0
    for word, n in counts.items():
        if found := columns[word]:
            hit += n
            for c in found:
                out[c] += n
    scale = 1000 / max(20, len(words))
    out[:n_terms] = np.log1p(out[:n_terms] * scale) / 4
    out[n_terms] = np.log1p(hit * scale)
    out[n_terms + 1 :] = form_of(text, words, counts)
    return out


#: Rows that a sum over the sample handles at once, so that the driver holds no second copy of it.
ROWS = 1_024


def weighted(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``weights.T @ x`` by blocks of rows."""
    return sum((weights[k : k + ROWS].T @ x[k : k + ROWS].astype(float) for k in range(0, len(x), ROWS)), 0.0)


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` by blocks of rows."""
    return np.concatenate([x[k : k + ROWS].astype(float) @ w for k in range(0, len(x), ROWS)])


def told(p: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """The conditional mutual information of all pairs of voters given the class, times the rows."""
    out = np.zeros((votes.shape[1], votes.shape[1]))
    for weights in (p, 1 - p):
        n = weights.sum()
        both = sum(((votes[k : k + ROWS] * weights[k : k + ROWS, None]).T @ votes[k : k + ROWS].astype(float) for k in range(0, len(votes), ROWS)), np.zeros_like(out))
        one = np.diag(both).copy()
        margins = (n - one, one)
        cells = ((n - one[:, None] - one + both, one - both), (one[:, None] - both, both))
        for i in (0, 1):
            for j in (0, 1):
                cell, expected = cells[i][j], np.outer(margins[i], margins[j]) / max(n, 1e-9)
                some = (cell > 1e-9) & (expected > 1e-9)
                out += np.where(some, cell, 0.0) * np.log(np.where(some, cell, 1.0) / np.where(some, expected, 1.0))
    return out


def dependencies(p: np.ndarray, votes: np.ndarray, least: float = 15.0) -> tuple[np.ndarray, float]:
    """Of each voter the one that it depends on within the classes, -1 for none: a maximum spanning forest
    of the pairs whose information, times the rows, is over ``least``. And the mean share of a voter's
    entropy that the other doesn't tell."""
    information = told(p, votes)
    m = len(information)
    parent, best, seen = np.full(m, -1), np.full(m, -np.inf), np.zeros(m, bool)
    for _ in range(m):
        k = int(np.argmax(np.where(seen, -np.inf, best)))
        k = int(np.flatnonzero(~seen)[0]) if seen[k] or best[k] == -np.inf else k
        seen[k] = True
        closer = ~seen & (information[k] > np.maximum(best, least))
        best[closer], parent[closer] = information[k][closer], k
    own = np.maximum(np.diag(information), 1e-9)  # what a voter tells of itself is its entropy
    return parent, float(np.where(parent >= 0, 1 - np.minimum(best / own, 1), 1.0).mean()) if m else 1.0


def label_model(votes: np.ndarray, marks: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, and each voter's rates of voting in classes 0 and 1 (the marks are
    the last voter)."""
    posterior, found, _, _ = generative(votes, marks, rounds)
    return posterior, found


def generative(votes: np.ndarray, marks: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior, rates, dependencies and conditional rates of the label model, by EM.

    votes: rows x voters, 0 or 1; marks: the given labels, one more voter that may err; their mean is the
    share of class 1. A voter that depends on another has a rate for each class and each vote of that one
    (voters x classes x votes); one that always votes as the other does tells nothing more. A tree carries
    one dependency for each voter where groups share more, so all votes but the mark's weigh the square of
    the mean share of a voter's entropy that the other doesn't tell. The dependencies are found from the
    marks and once more from the first posterior.
    """
    prior = float(np.clip(marks.mean(), 1e-3, 0.999))
    p = np.where(marks == 1, 0.9, 0.05)
    all_votes = np.column_stack([votes, marks]).astype(np.uint8)
    m = all_votes.shape[1]
    for _ in range(2):
        parent, left = dependencies(p, all_votes[:, :-1])
        parent, weight = np.append(parent, -1), left * left
        held = parent >= 0
        both = np.where(held, all_votes[:, parent] & all_votes, 0).astype(np.uint8)
        for _ in range(rounds):
            classes = np.column_stack([1 - p, p])
            n, ones, pairs = classes.sum(0)[:, None], weighted(classes, all_votes), weighted(classes, both)
            marginal = np.clip((ones + 0.1) / (n + 1), 1e-4, 1 - 1e-4)
            of = np.where(held, ones[:, parent], 0.0)  # how often the other votes
            given1 = np.where(held, (pairs + 2 * marginal) / (of + 2), marginal)
            given0 = np.where(held, (ones - pairs + 2 * marginal) / (n - of + 2), marginal)
            rate = np.clip(np.stack([given0, given1], 2), 1e-4, 1 - 1e-4)  # class, voter, vote of the other
            yes, no = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
            alone = yes[:, 0] - no[:, 0]
            with_other = np.bincount(parent[held], (no[:, 1] - no[:, 0])[held], m)
            together = np.where(held, yes[:, 1] - no[:, 1] - alone, 0.0)
            rest = no[:-1, 0].sum() + times(all_votes[:, :-1], (alone + with_other)[:-1]) + times(both, together)
            score = math.log(prior / (1 - prior)) + weight * rest + np.where(all_votes[:, -1] == 1, yes[-1, 0], no[-1, 0])
            new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            done = np.abs(new - p).max() < 1e-4
            p = new
            if done:
                break
    return p, marginal.T, parent, rate.transpose(1, 0, 2)


def linear(x: np.ndarray, y: np.ndarray, l2: float = 2.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    k = x.shape[1]
    w, bias, ridge = np.zeros(k), 0.0, np.append(np.full(k, l2), 1e-3)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(times(x, w) + bias, -30, 30)))
        slope = np.append(weighted(q - y, x), (q - y).sum()) + ridge * np.append(w, bias)
        curve = np.zeros((k + 1, k + 1))
        for at in range(0, len(x), ROWS):
            rows = np.column_stack([x[at : at + ROWS].astype(float), np.ones(len(x[at : at + ROWS]))])
            curve += (rows * (q * (1 - q))[at : at + ROWS, None]).T @ rows
        step = np.linalg.solve(curve + np.diag(ridge), slope)
        w, bias = w - step[:-1], bias - step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return w, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_fit_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside the held-out fold; at most about ``max_fit_rows``,
    the same ones each time, taken by a hash of the identifier."""
    marks = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held).dropDuplicates(["doc_id"])
    n = marks.count()
    if n > max_fit_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_fit_rows / n))
    return docs.join(marks, "doc_id")


@lean
def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch: every term with its number of rows, and of rows marked toxic."""
    for batch in batches:
        rows, marked = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = {t for word in set(WORD.findall(text.lower())) if len(word) > 2 for t in terms_of(word)}
            rows.update(found)
            if toxic:
                marked.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.array([marked[t] for t in rows], pa.int64())], names=["term", "rows", "marked"])


def chosen(ranked: list[str], max_terms: int) -> list[str]:
    """All terms that no beginning among them implies, and of the others the first up to ``max_terms`` in
    all, in the order given."""
    stems = {t for t in ranked if t.endswith("*")}
    implied = [t for t in ranked if any(t[:k] + "*" in stems for k in STARTS if k < len(t.rstrip("*")))]
    spare = max(0, max_terms - (len(ranked) - len(implied)))
    left = set(implied[spare:])
    return [t for t in ranked if t not in left]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_fit_rows: int = 12_000, max_terms: int = 250) -> ToxicityModel:
    """Fits on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Without a single row of each class
    there are no voters and all texts get the same score. ``max_terms`` bounds the lexicon's spellings of
    beginnings that are terms themselves; terms that vote on their own are all kept."""
    rows = keep(training_rows(docs, labels, folds, held, max_fit_rows).select("text", "toxic"))
    marked = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, pos = int(marked[0]), int(marked[1])
    if not pos or pos == n:
        return ToxicityModel({}, [0.0] * (1 + len(PATTERNS)), math.log((pos + 0.5) / (n - pos + 0.5)))
    counts = rows.select("text", "toxic").mapInArrow(term_counts, "term string, rows long, marked long").groupBy("term").agg(F.sum("rows").alias("rows"), F.sum("marked").alias("marked"))
    share = pos / n
    expected = F.col("rows") * F.lit(share)
    stands_out = (F.col("marked") - expected) / F.sqrt(expected * (1 - share) + 0.25)
    lift = (F.col("marked") / F.lit(pos)) / ((F.col("rows") - F.col("marked") + 0.5) / F.lit(n - pos))
    best = counts.where("marked >= 4").withColumn("z", stands_out).where((F.col("z") > 4) & (lift > 4)).orderBy(F.desc("z"), "term")
    terms = {t: k for k, t in enumerate(chosen([r.term for r in best.select("term").collect()], max_terms))}
    k = len(terms)

    @lean
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = columns_of(terms)
        for batch in batches:
            x = [rates(t, k, columns) for t in batch.column("text").to_pylist()]
            places = [np.flatnonzero(row) for row in x]
            values = [row[at].astype(np.float32) for row, at in zip(x, places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["toxic", "at", "x"])

    sample = rows.mapInArrow(inputs, "toxic int, at array<int>, x array<float>").toArrow()  # mostly zeros
    marks = sample.column("toxic").to_numpy()
    x = np.zeros((len(marks), k + 1 + len(PATTERNS)), np.float32)
    at, values = sample.column("at").combine_chunks(), sample.column("x").combine_chunks()
    x[np.repeat(np.arange(len(marks)), at.value_lengths()), at.flatten()] = values.flatten()
    discard(rows)
    votes = np.column_stack([x[:, :k] > 0, x[:, k + 1 :] > 0.3])  # any term at all would be no voter of its own
    posterior, estimated, parents, given = generative(votes, marks)
    weights, bias = linear(x, posterior)
    names = [*terms, *PATTERNS, "mark"]
    accuracies = {m: (float(a), float(b)) for m, (a, b) in zip(names, estimated, strict=True)}
    correlations = {(m, names[o]): tuple(map(float, g.ravel())) for m, o, g in zip(names, parents, given, strict=True) if o >= 0}
    return ToxicityModel(terms, weights.tolist(), bias, accuracies, correlations)


def probabilities(texts: Iterable[str | None], model: ToxicityModel, columns: Mapping[str, tuple[int, ...]]) -> list[float]:
    """The scores of texts; null counts as empty."""
    weights = np.array(model.weights)
    z = np.array([float(rates(t or "", len(model.terms), columns) @ weights) for t in texts]) + model.bias
    return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the score of a text
    without words. A null identifier is in no fold and counts as not held out; rows repeated with one
    identifier are scored each; an empty table gives no rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = columns_of(model.terms)
        for batch in batches:
            found = probabilities(batch.column("text").to_pylist(), model, columns)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    out = id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fits on the rows of ``df`` that ``labels`` marks and scores all rows."""
    return score(df, fit(id_and_text(df, id_col, text_col), labels, **options), id_col, text_col)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, with all their columns. Rows are judged one by one
    where they are, so nothing is shuffled and repeated or null identifiers make no difference."""
    model = fit(id_and_text(df, id_col, text_col), labels, **options)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = columns_of(model.terms)
        for batch in batches:
            yield batch.filter(pa.array([p < 0.5 for p in probabilities(batch.column(text_col).to_pylist(), model, columns)], pa.bool_()))

    return df.mapInArrow(run, df.schema)

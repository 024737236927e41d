"""The corpus pipeline: toxic documents go, then exact copies, then near copies; what stays is mixed to
the target weights and packed into sequences.

All stages take any columns beside those of documents and any names of them, and an empty table, of which
nothing comes out. Rows repeated with one identifier and rows without one are documents like others, except
where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm.common import discard, keep_alone, read
from lexigrain.llm.exact_dedup import drop_copies
from lexigrain.llm.mixing import select_mixture
from lexigrain.llm.near_dedup import drop_near_copies
from lexigrain.llm.packing import pack
from lexigrain.llm.queries import tokenizer_path
from lexigrain.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. A null text counts as empty; empty texts are scored like texts
    without words and stay; a text of any length is scored whole."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier, null the least; null counts as empty, so of
    empty texts one stays. Rows repeated with identifier and text stay or go together."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the document with the least identifier. Texts
    without words are near nothing, shorter ones are one shingle; documents without an identifier stay."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, a row for each epoch in which it does (at most four); the budget is as many
    tokens as there are. Null languages and sources are leaves named unknown; a document that doesn't fit what is
    left of its leaf's budget isn't taken in that epoch."""
    return select_mixture(docs, max_epochs=4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence. An empty text is its end token."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]
#: Toxicity and near copies are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder, and what came before
    is removed."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, keep_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``: five operators, one after the other, on all that the last one kept.

In every stage null and empty texts and rows without an id are documents like any other and stay; rows that repeat an
id are judged by their texts, and stay or go together where an id is what is judged; columns that the stages do not
know pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.decontaminate import drop_contaminated
from quern.llm.neardup import drop_near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.passages import cut_passages
from quern.llm.queries import table, word_tokenizer
from quern.llm.toxicity import drop_toxic


def lean(stage):
    """``stage``, begun with executors whose heaps hold nothing of the stages before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.shrink_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; equal texts are judged alike, ties with it go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


@lean
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages of fifty words or more that an earlier one has."""
    cut = cut_passages(docs, words=50, percent=80)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


@lean
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, not even once."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces and their places in sequences of at most 4096 ids."""
    return pack_documents(docs, word_tokenizer(), 4096, 1)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]
#: Models, similarity components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

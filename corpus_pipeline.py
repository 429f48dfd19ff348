"""The corpus pipeline: five of the operators in a row over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.  Repeated rows share
their fate, columns of any other name pass through, and an empty table gives no
rows.  What a stage does with nulls is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import cross_parse, kneser_ney, lsh_forest, pattern_packing, raking, store
from lanternfish.session import read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language go on; a text that is null, empty or without a letter goes."""
    return cross_parse.reject(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity thresholds go on, and so do those without text, language or trusted text in it."""
    return kneser_ney.reject(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) goes on, that with the smallest id, and all rows without an id or without words."""
    return lsh_forest.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities; a null source or language is a class of its own, and all rows without an id are drawn alike."""
    return raking.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences; a null text is an empty one."""
    return pattern_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packing", packing),
]

# Automata, perplexities and token ids are beyond SQL; the tests hold the stages
# against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids in five stages; each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result to a table in
the shared folder and reads it again as the next one's docs; the table before it goes.

Defined cases, in every stage: an empty table gives an empty one; a null text has no language, so it goes in the first
stage (later ones treat it as empty); rows without an id are kept, are no copies and no references of others, and
repeat nothing; rows of one id with different texts are judged text by text, and of rows with the same id and text one
stays; ties go to the smallest id; texts of any length are read whole; further columns, whatever their names, are
carried through to the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesselake.llm import decontaminate, langid, neardup, substring, tokens
from tesselake.llm.common import Shelf, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter) go."""
    return langid.identified(docs, langid.training_sample(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near or exact copies stays."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; the document stays with the rest of its text."""
    return substring.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with the digests of ids and decoded bytes."""
    return tokens.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]
#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        shelf.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
